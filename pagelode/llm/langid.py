"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit, on hashed byte n-grams of the
lower-cased text, predicts that bit. Decoding weighs the loss of each bit by how reliable its
classifier was on held-back rows, chooses the codeword of least loss and flags texts whose second
best is nearly as good. Classifiers are logistic and trained in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.shared import ship

DIMENSIONS = 8192
#: Rows a language gives to the training sample, about.
SAMPLE_PER_LANGUAGE = 400
#: Bytes of a text whose n-grams are counted at once.
BLOCK = 2 << 20
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1, one row each: all useful splits for few languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(bits, float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice((-1.0, 1.0), (n, width)) for _ in range(200)]
    return max(tries, key=lambda m: ((m[:, None] != m[None]).sum(-1) + width * np.eye(n, dtype=int)).min())


def features(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte n-grams, n = 1 to 4, of the whole text."""
    data = (text or "").lower().encode()
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + 3, len(data) - at), at).astype(np.uint32)
        g = b.copy()
        for n in range(1, 5):
            if n > 1:
                if len(g) < 2:
                    break
                g = g[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
            own = g[:BLOCK]  # grams that begin in this block
            counts += np.bincount(((own + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


class Model:
    """Weights of the bit classifiers, the codewords and the weights of the bits in decoding."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.bias, self.trust = languages, codes, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword, one row per text."""
        z = x @ self.weights + self.bias
        return (np.logaddexp(0, -z[:, None, :] * self.codes[None]) * self.trust).sum(-1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; `und`, 0 and True without a letter."""
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        out = []
        for text in texts:
            if not text or not _LETTER.search(text):
                out.append(("und", 0.0, True))
                continue
            loss = self.losses(features(text)[None])[0]
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            k = int(p.argmax())
            second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
            out.append((self.languages[k], float(p[k]), bool(second > 0.5 * p[k])))
        return out


def train(texts: list[str], langs: list[str], rounds: int = 150, seed: int = 7) -> Model:
    """Bit classifiers by full-batch Adam on logistic loss; a fifth of the rows measures the bits' reliability."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    back = np.random.default_rng(seed).random(len(texts)) < 0.2 if len(texts) >= 20 else np.zeros(len(texts), bool)
    order = np.argsort(back, kind="stable")  # rows held back come last, so that both parts are views
    x = np.empty((len(texts), DIMENSIONS), np.float32)
    for k, i in enumerate(order):
        x[k] = features(texts[i])
    y = codes[np.searchsorted(languages, [langs[i] for i in order])].astype(np.float32)
    taught = int((~back).sum())
    w, b = np.zeros((DIMENSIONS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    xt, yt = x[:taught], y[:taught]
    for step in range(1, rounds + 1):
        z = xt @ w + b
        g = -yt / (1 + np.exp(np.clip(yt * z, -30, 30))) / len(xt)
        for p, grad, k in ((w, xt.T @ g + 1e-6 * w, 0), (b, g.sum(0), 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
            p -= 0.3 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    hits = ((x[taught:] @ w + b) * y[taught:] > 0).mean(0) if back.any() else np.ones(y.shape[1])
    trust = np.clip(2 * hits - 1, 0.05, 1)
    return Model(languages, codes, w.astype(np.float64), b.astype(np.float64), trust)


def below(hashed: Column, shares: dict, of: str) -> Column:
    """True for rows whose hash lies below the share of its range that the value of column `of` has in `shares`."""
    if not shares:
        return F.lit(False)
    bound = F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, min(v, 1.0))))
    return F.pmod(hashed, F.lit(1 << 30)) < F.element_at(bound, F.col(of)) * (1 << 30)


def sample(df: DataFrame, allowed: Column, per: int, text: str, lang: str, doc_id: str) -> DataFrame:
    """About `per` rows of each language (all, if fewer), chosen by a hash of id and text, out of rows with text and language."""
    rows = df.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("__at"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    return rows.filter(below(F.col("__at"), {k: per / n for k, n in counts.items()}, "lang")).select("text", "lang")


def fit(df: DataFrame, allowed: Column, per: int = SAMPLE_PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from about `per` rows a language among those that `allowed` admits.

    No such row: a model that calls everything `und`.
    """
    rows = sorted((r["text"], r["lang"]) for r in sample(df, allowed, per, text, lang, doc_id).collect())  # about `per` rows a language
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, lang_score (0 to 1) and lang_ambiguous for every whole text.

    Null texts and texts without a letter are `und` with score 0 and flagged. Other columns pass;
    columns of the new names are replaced.
    """
    ship(df.sparkSession)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())]
    df = df.drop(*(f.name for f in new))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                found = shared.value.predict(part.column(part.schema.get_field_index(text)).to_pylist())
                arrays = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))
