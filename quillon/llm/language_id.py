"""Operator 3, language ID by multilingual mixture inference: expectation-maximisation estimates
each document's language proportions from the n-gram likelihoods of its words, and a penalised
likelihood selects the set of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._base import text_chunks

#: Labelled documents of each language that the likelihoods are learnt from, about (each document
#: is taken with the same chance, by a hash of its id).
SAMPLE_PER_LANGUAGE = 1_000
#: Buckets of hashed letter trigrams.
BUCKETS = 1 << 16
#: Bytes of text times languages that one pass holds at most, unless a single text has more.
PASS = 1 << 25
#: Letters times languages whose likelihoods are looked up at a time.
BLOCK = 1 << 22
#: EM ends when no share moves by more than this in a round. Rounds that look for a start: see _grown.
TOLERANCE, SET_ROUNDS = 2e-4, 6


@dataclass(frozen=True)
class Model:
    """Log likelihoods of trigram buckets by language, in the order of `languages`."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram bucket centred at each letter, where words begin among the letters, and the
    text of each word. A word is a run of letters; its edges count as spaces."""
    lowered = [t.decode().lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le"), np.uint32)
    letter = _bpe._classes()[points] == _bpe.L
    c = np.where(letter, points, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[(at + 1) % max(len(c), 1)] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    begins = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return (h >> np.uint32(16)).astype(np.int64), begins, np.searchsorted(ends, at[begins], "right")


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The trigram model of the labelled rows, from about per_language documents each.

    Rows without text, label or id aren't used. Ties and repeated rows count as they come. Only
    counts by bucket and language reach the driver; a language takes 256 KB of the model, and the
    labels decide how many there are.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    chances = labelled.sparkSession.createDataFrame([(lang, per_language / n) for lang, n in sizes.items()], "lang string, chance double")
    sample = rows.join(F.broadcast(chances), "lang").where(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, texts in text_chunks(batches):
            names = np.array([place[x] for x in part.column(1).to_pylist()])
            h, begins, owner = _letters(texts)
            new, n = np.unique(np.repeat(names[owner], np.diff(begins, append=len(h))) * BUCKETS + h, return_counts=True)
            codes, inverse = np.unique(np.append(codes, new), return_inverse=True)
            both = np.zeros(len(codes), np.int64)
            np.add.at(both, inverse, np.append(sums, n))
            sums = both
        yield pa.RecordBatch.from_arrays([pa.array(codes // BUCKETS, pa.int32()), pa.array(codes % BUCKETS, pa.int32()), pa.array(sums, pa.int64())], ["k", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    bucket, k, n = (got[c].to_numpy() for c in ("bucket", "k", "n"))
    order = np.argsort(k, kind="stable")
    ends = np.searchsorted(k[order], np.arange(len(languages) + 1))
    log_p = np.empty((BUCKETS, len(languages)), np.float32)
    for j in range(len(languages)):
        of = order[ends[j] : ends[j + 1]]
        column = np.full(BUCKETS, 0.1)
        column[bucket[of]] += n[of]
        log_p[:, j] = np.log(column / column.sum())
    return Model(languages, log_p)


def infer(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions of the selected languages (rows of zeros: no letter), and the
    number of its words.

    Sets grow by the language that raises the likelihood most, for as long as a larger set could
    still have the best penalised likelihood: sizes aren't capped, and no share is too small. Then
    languages are dropped from the best set for as long as that raises its penalised likelihood.
    """
    if len(texts) > 1 and sum(map(len, texts)) * len(model.languages) > PASS:
        halves = [infer(model, part) for part in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
        return np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
    out = np.zeros((len(texts), len(model.languages)))
    h, begins, owner = _letters(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(n_words)
    if not len(some) or not model.languages:
        return out, n_words
    step = max(1, BLOCK // len(model.languages))
    cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(h), step)), len(begins)))
    edges = np.append(begins, len(h))
    word = np.concatenate([np.add.reduceat(model.log_p[h[edges[a] : edges[b]]], begins[a:b] - begins[a], axis=0) for a, b in zip(cuts, cuts[1:])])
    word = np.exp(np.maximum(word - word.max(1, keepdims=True), -60))
    first = np.cumsum(n_words[some]) - n_words[some]
    place = np.repeat(np.arange(len(some)), n_words[some])
    shares, _ = _em(word, place, first, n_words[some], np.full((len(some), word.shape[1]), 1 / word.shape[1]))
    # One language: the one with the highest likelihood of all words.
    one = np.add.reduceat(np.log(word), first, axis=0, dtype=np.float64)
    best, score = np.zeros_like(shares), one.max(1)
    best[np.arange(len(some)), one.argmax(1)] = 1
    most = _bound(word, place, first, n_words[some], shares)
    held, todo = best.copy(), np.arange(len(some))
    for size in range(2, shares.shape[1] + 1):
        # No set of this size or a larger one has a higher likelihood than the bound.
        todo = todo[most[todo] - (size - 1) * np.log(n_words[some][todo] + 1) > score[todo]]
        if not len(todo):
            break
        n = n_words[some][todo]
        words, at, begin = word[np.isin(place, todo)], np.repeat(np.arange(len(todo)), n), np.cumsum(n) - n
        start = _grown(words, at, begin, n, held[todo], shares[todo])
        got, fit_ = _em(words, at, begin, n, start)
        held[todo] = got
        fit_ -= (size - 1) * np.log(n + 1)  # BIC, doubled: a share is a parameter
        better = fit_ > score[todo]
        best[todo[better]], score[todo[better]] = got[better], fit_[better]
    todo = np.flatnonzero((best > 0).sum(1) > 2)  # of two, each alone has been tried
    while len(todo):
        without, gain = best[todo].copy(), score[todo].copy()
        for k in range(best.shape[1]):
            mine = np.flatnonzero(best[todo, k] > 0)
            if not len(mine):
                continue
            start, n = best[todo[mine]].copy(), n_words[some][todo[mine]]
            start[:, k] = 0
            start /= np.maximum(start.sum(1, keepdims=True), 1e-300)
            words, at, begin = word[np.isin(place, todo[mine])], np.repeat(np.arange(len(mine)), n), np.cumsum(n) - n
            got, fit_ = _em(words, at, begin, n, start)
            fit_ -= ((start > 0).sum(1) - 1) * np.log(n + 1)
            better = fit_ > gain[mine]
            without[mine[better]], gain[mine[better]] = got[better], fit_[better]
        raised = gain > score[todo]
        best[todo[raised]], score[todo[raised]] = without[raised], gain[raised]
        todo = todo[raised]
        todo = todo[(best[todo] > 0).sum(1) > 2]
    out[some] = best
    return out, n_words


def _bound(word: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """What the log likelihood of no mixture exceeds: that at the shares and, as it is concave, n
    times the logarithm of the largest mean ratio of a language's likelihood to the mixture's."""
    total = _mixed(word, shares, place)
    ratio = np.add.reduceat(word / total[:, None], first, axis=0) / n[:, None]
    return np.add.reduceat(np.log(total), first) + n * np.log(np.maximum(ratio.max(1), 1))


def _grown(word: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, held: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The mixtures held, each with the language added that raises its likelihood most. Every
    language is tried with a share of its own, found by rounds from its share in all of them."""
    mixed = _mixed(word, held, place)[:, None]
    part = np.clip(shares, 1 / (n[:, None] + 1), 0.5)
    for _ in range(SET_ROUNDS):
        added = word * part[place]
        part = np.add.reduceat(added / (added + mixed * (1 - part[place])), first, axis=0) / n[:, None]
    gain = np.add.reduceat(np.log(word * part[place] + mixed * (1 - part[place])), first, axis=0)
    k = np.where(held > 0, -np.inf, gain).argmax(1)
    row = np.arange(len(held))
    own = np.clip(part[row, k], 1 / (n + 1), 0.5)
    out = held * (1 - own)[:, None]
    out[row, k] = own
    return out


def _mixed(word: np.ndarray, shares: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", word, shares[place], dtype=np.float64)


def _em(word: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares at which EM stands still, and the log likelihood under those before its last
    round. Texts that stand still leave the arrays."""
    out, fits, todo = np.zeros(shares.shape), np.zeros(len(n)), np.arange(len(n))
    while len(todo):
        joint = word * shares.astype(np.float32)[place]
        total = joint.sum(1)
        joint /= total[:, None]
        new = np.add.reduceat(joint, first, axis=0, dtype=np.float64) / n[:, None]
        out[todo], fits[todo] = new, np.add.reduceat(np.log(total.astype(np.float64)), first)
        moves = np.abs(new - shares).max(1) > TOLERANCE
        if moves.mean() < 0.7:
            word, todo, n, new = word[moves[place]], todo[moves], n[moves], new[moves]
            place, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        shares = new
    return out, fits


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score, languages and proportions (of the selected
    set, largest first).

    score is lang_pred's proportion. Null and empty texts, and those without a letter, are `und`
    with score 0 and no languages, as is everything under a model of no language. Equal
    proportions go to the language that sorts first. Repeated ids and rows stay; other columns
    aren't read; an empty table gives an empty table. The model is broadcast: 256 KB a
    language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            lang, score, names, shares = predict(held.value, texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, lang_pred string, score double, languages array<string>, proportions array<double>")


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
    shares, _ = infer(model, texts)
    names, values = [], []
    for row in shares:
        order = sorted(np.flatnonzero(row > 0).tolist(), key=lambda k: (-row[k], k))
        names.append([model.languages[k] for k in order])
        values.append([min(1.0, float(row[k])) for k in order])
    return [x[0] if x else "und" for x in names], [x[0] if x else 0.0 for x in values], names, values


def reject_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns kept, without those whose language can't be told (`und`)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([*b.columns, b.column(at)], [*(str(k) for k in range(b.num_columns)), "text"]) for b in batches)
        for rows, texts in text_chunks(named):
            known = pa.array([x != "und" for x in predict(held.value, texts)[0]], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(known) for c in rows.columns[:-1]], names)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32(doc_id as text) mod 4 is 2; null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
