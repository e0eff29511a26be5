"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into a
fixed number of buckets; a linear softmax over the average names the language.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample.  A part of the sample is held back to scale the
softmax (one temperature), and to set the confidence, and the share of n-grams
that training has seen, below which a prediction is rejected.  As both layers are linear, prediction adds one row of scores for
each n-gram.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Most documents of a language that the classifier is fitted on.
PER_LANGUAGE = 500
EPOCHS = 10
RATE = 0.5
#: Share of right predictions, on the part held back, that rejection may cost.
REJECTED = 0.001
#: Of the share of known n-grams that all but so few right predictions have, what a text needs.
FAMILIAR = 0.75
UNKNOWN = "und"

_FOLD = c.LOWER.copy()
_FOLD[[x for x in range(128) if not 97 <= _FOLD[x] <= 122]] = 32
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the number of the text of each; a gram that begins with two gaps is left out."""
    b = _FOLD[data].astype(np.uint32)
    n = len(b)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    out, of = [], []
    for k in GRAMS:
        if n < k:
            continue
        x = b[: n - k + 1].copy()
        for j in range(1, k):
            x |= b[j : n - k + 1 + j] << np.uint32(8 * j)
        keep = (at[: len(x)] + k <= end[: len(x)]) & ((x & np.uint32(0xFFFF)) != 0x2020)
        x = x[keep] * np.uint32(2654435761) + np.uint32(k * 40503)
        out.append(((x ^ (x >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16))
        of.append(text[: n - k + 1][keep])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTERS[data])])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        raw = data[offsets[d] : offsets[d + 1]]
        found[d] = bool(raw.max() >= 128 and _LETTER.search(raw.tobytes().decode()))
    return found


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: what an n-gram adds
    bias: np.ndarray
    temperature: float
    least: float  # confidence below which a prediction is rejected
    seen: np.ndarray | None = None  # whether the sample has n-grams of a bucket
    familiar: float = 0.0  # share of such n-grams below which a text is in no learned language

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and acceptance of each text; texts without letters are unknown, with 0, and rejected."""
        names, scores, strange = [], [], []
        for _, rows, data, offsets in c.text_blocks(column, 1 << 19):
            letters = has_letters(data, offsets)
            buckets, of = gram_buckets(data, offsets)
            held = np.maximum(np.bincount(of, minlength=rows), 1)
            z = np.stack([np.bincount(of, self.scores[buckets, k], rows) / held + self.bias[k] for k in range(len(self.languages))], axis=1) if self.languages else np.zeros((rows, 0))
            p = _softmax(z / self.temperature) if self.languages else np.zeros((rows, 1))
            known = letters & bool(self.languages)
            best = p.argmax(axis=1)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            scores.append(np.where(known, p.max(axis=1), 0.0))
            if self.seen is None:
                strange.append(np.zeros(rows, bool))
            else:
                strange.append(np.bincount(of, self.seen[buckets], rows) < self.familiar * held)
        scores = np.concatenate(scores) if scores else np.zeros(0)
        return names, scores, np.array([x != UNKNOWN for x in names], bool) & (scores >= self.least) & ~np.concatenate([np.zeros(0, bool), *strange])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """From (language, buckets, counts) of each sample, in a fixed order."""
    languages = sorted({x[0] for x in samples})
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    code = {x: k for k, x in enumerate(languages)}
    rows = [(code[x], b, n, int(n.sum())) for x, b, n in samples if len(b)]  # narrow integers: the driver holds them all
    train = [r for k, r in enumerate(rows) if k % 5]
    back = [r for k, r in enumerate(rows) if not k % 5]
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            y, b, n, total = train[k]
            b, share = b.astype(np.int64), n / total
            rate = RATE * (1 - done / steps)
            v = share @ e[b]
            g = _softmax(v @ w + bias)
            g[y] -= 1
            # the embeddings' step is scaled up: shares are small
            e[b] -= rate * np.outer(np.minimum(share * 100, 1.0), w @ g)
            w -= rate * np.outer(v, g)
            bias -= rate * g
            done += 1
    scores = (e @ w).astype(np.float32)
    model = Model(languages, scores, bias, 1.0, 0.0)
    if back:
        z = np.stack([(n / total) @ scores[b] + bias for _, b, n, total in back])
        y = np.array([r[0] for r in back])
        loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        # a right prediction of an unseen text is about this seldom less certain, and half is enough for any
        model.least = float(min(0.5, np.quantile(right, REJECTED))) if len(right) else 0.0
        model.seen = np.zeros(BUCKETS, bool)
        for _, b, _, _ in train:
            model.seen[b.astype(np.int64)] = True
        shares = np.array([n[model.seen[b.astype(np.int64)]].sum() / total for _, b, n, total in back])[p.argmax(axis=1) == y]
        model.familiar = float(FAMILIAR * np.quantile(shares, REJECTED)) if len(shares) else 0.0
    return model


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with a language that are not held out: about per_language of each language, chosen by a hash of id and text.

    No labelled rows: a model that knows no language and rejects every text.
    """
    c.importable(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("out"))
    own = own.where("not out and lang is not null and text is not null")
    counts = {r.lang: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    share = F.create_map([F.lit(x) for k, n in counts.items() for x in (k, per_language / n)])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches):
        for batch in batches:
            key, text, lang = batch.columns
            at = 0
            for _, rows, data, offsets in c.text_blocks(text):
                buckets, of = gram_buckets(data, offsets)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(rows + 1))
                pairs = [np.unique(buckets[order[a:b]], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([key.slice(at, rows), lang.slice(at, rows), pa.array([c.join_arrays(x.astype(np.uint16), c.narrow(n)) for x, n in pairs], pa.binary())], names=["id", "lang", "grams"])
                at += rows

    rows = own.where(share.isNotNull() & (draw < share)).select("id", "text", "lang").mapInArrow(c.tidy(run), "id string, lang string, grams binary").collect()
    rows.sort(key=lambda r: (r.id or "", r.lang, bytes(r.grams)))
    return fit([(r.lang, *c.split_arrays(bytes(r.grams))) for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row of docs, from its whole text alone.

    A null text, or one without letters, is "und" with score 0 and not
    accepted.  Repeated rows have a row each; a null id counts as the empty
    text for held_out.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores, ok = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(c.tidy(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language the model accepts; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.predict(batch.column(at))[2], pa.bool_()))

    return c.map_rows(docs, c.tidy(run), docs.schema)
