"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A text's tokens are split at white space; each gives two terms, the token with A-Z lower-cased and its shape (runs of
letters, digits and signs as one character each, of which a shape has `SHAPE` at most). Every term has a sparse random
index vector, drawn from its hash. A term's word vector is the normalised sum of the index vectors of the terms around
it in the training texts. A document's features are the mean vectors of its words and of its shapes, over its whole
text, with the share of words that are known and the logarithm of its number of tokens. The network has one hidden
layer; its probabilities are calibrated by a temperature and an offset fitted on a quarter of the training rows that it
isn't trained on.

What is learnt from is bounded, by parameters: `MAX_ROWS` labelled rows, those of the smallest hash of their id and
text, of at most `MAX_BYTES` of text each (longer ones are scored whole but not trained on). The model's terms are
those in `MIN_TEXTS` training texts at least, `MAX_WORDS` of them, the most frequent first. So the driver holds the
sample, at most MAX_ROWS * MAX_BYTES, and the model, some 8 MB at any corpus size, which is broadcast. Scoring is a map
over documents: no shuffle, no hot keys, and what a task caches goes with the task.

Defined cases: null and empty texts have zero features and a score; rows without a label or with a null text aren't
trained on, nor are ids whose labels contradict each other; rows that repeat a doc_id are scored each, and may be
trained on each; with no labelled rows, or one class only, the score is that class's share (0.5 if there is none);
other columns, among them lang, source and doc_id, are no inputs of a score; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import picked, released, table, vacated
from .simhash import mix

MAX_ROWS, MAX_BYTES = 4000, 32 << 10
MAX_WORDS, MIN_TEXTS, SHAPE = 30_000, 3, 12
DIM, NONZERO, REACH, HIDDEN = 64, 6, 2, 32
THRESHOLD = 0.3
#: Distinct tokens that a task keeps the places of.
_CACHE = 150_000
_RUNS = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    """A translation table: letters to a or A, digits to 9, other characters to themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


def shape(token: str, kinds: _Kinds) -> str:
    return _RUNS.sub(r"\1", token.translate(kinds))[:SHAPE]


def index_vectors(terms: list[str]) -> np.ndarray:
    """A row for each term: NONZERO times 1 or -1 added at places drawn from the term's hash."""
    h = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))
    out = np.zeros((len(terms), DIM), dtype=np.float32)
    for i in range(NONZERO):
        with np.errstate(over="ignore"):
            drawn = mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1))
        out[np.arange(len(terms)), (drawn >> np.uint64(1)) % np.uint64(DIM)] += 1 - 2 * (drawn & np.uint64(1)).astype(np.float32)
    return out


def _summed(matrix: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """matrix[at] += rows, where a place may occur many times."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    if len(places):
        matrix[places] += np.add.reduceat(rows[order], first, axis=0)


class Vectors:
    """Word vectors, and the pooling of a text by them."""

    def __init__(self, ids: dict[str, int], matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.cache: dict[str, tuple[int, int]] = {}
        self.kinds = _Kinds()

    def __getstate__(self):
        return self.ids, self.matrix

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def learn(cls, texts: list[str], max_words: int = MAX_WORDS) -> Vectors:
        kinds, seen = _Kinds(), {}
        for t in texts:
            own = set(t.split())
            for x in {"w" + x.lower() for x in own} | {"s" + shape(x, kinds) for x in own}:
                seen[x] = seen.get(x, 0) + 1
        terms = [t for t, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= MIN_TEXTS][:max_words]
        index = np.concatenate([index_vectors(terms), np.zeros((1, DIM), dtype=np.float32)])
        self = cls({t: i for i, t in enumerate(terms)}, np.zeros_like(index))
        for t in texts:
            w, s = self.look(t.split())
            both = index[w] + index[s]
            around = np.zeros_like(both)
            for d in range(1, REACH + 1):
                around[d:] += both[:-d]
                around[:-d] += both[d:]
            _summed(self.matrix, w, around)
            _summed(self.matrix, s, around)
        self.matrix[-1] = 0
        norm = np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.matrix /= np.maximum(norm, 1e-9)
        return self

    def look(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the tokens' words and shapes; what isn't known is the last place."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        cache, ids, none, kinds = self.cache, self.ids, len(self.ids), self.kinds
        for t in set(tokens).difference(cache):
            cache[t] = ids.get("w" + t.lower(), none), ids.get("s" + shape(t, kinds), none)
        flat = np.fromiter(itertools.chain.from_iterable(map(cache.__getitem__, tokens)), np.int32, 2 * len(tokens))
        return flat[::2], flat[1::2]

    def pool(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        out = np.zeros(2 * DIM + 2, dtype=np.float32)
        n = len(tokens)
        if not n:
            return out
        known = 0
        for i in range(0, n, 1 << 16):
            w, s = self.look(tokens[i : i + (1 << 16)])
            w = w[w < len(self.ids)]
            known += len(w)
            places, counts = np.unique(s, return_counts=True)
            out[:DIM] += self.matrix[w].sum(axis=0)
            out[DIM : 2 * DIM] += counts.astype(np.float32) @ self.matrix[places]
        out[:DIM] /= max(known, 1)
        out[DIM : 2 * DIM] /= n
        out[2 * DIM :] = known / n, np.log1p(n) / 10
        return out


class Network:
    """Inputs, HIDDEN units (tanh), one output; probabilities after calibration."""

    def __init__(self, n_in: int):
        rng = np.random.default_rng(0)
        self.w1 = rng.normal(0, n_in**-0.5, (n_in, HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        self.b2 = 0.0
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)
        self.temperature, self.offset = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature + self.offset)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 120, rate: float = 3e-3, decay: float = 1e-3) -> Network:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, rng = (x - self.mean) / self.scale, np.random.default_rng(1)
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                a = np.tanh(x[own] @ params[0] + params[1])
                d = (_sigmoid(a @ params[2] + params[3][0]) - y[own]) / len(own)
                back = np.outer(d, params[2]) * (1 - a * a)
                grads = [x[own].T @ back + decay * params[0], back.sum(axis=0), a.T @ d + decay * params[2], np.array([d.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature and offset of the least log loss, on a grid."""
        z, best = self.logits(x), np.inf
        for t in np.geomspace(0.25, 8, 41):
            for o in np.linspace(-1, 1, 21):
                p = np.clip(_sigmoid(z / t + o), 1e-6, 1 - 1e-6)
                loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
                if loss < best:
                    best, self.temperature, self.offset = loss, float(t), float(o)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, vectors: Vectors | None, network: Network | None, share: float):
        self.vectors, self.network, self.share = vectors, network, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        x = np.array([self.vectors.pool(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        return self.network.probabilities(x)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of labels.quality, from at most max_rows labelled documents that aren't held out."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("z")).where("y = z")
    # The labels of the smallest hashes are few enough to broadcast; twice as many as rows, as some have no text to train on.
    ids = one.orderBy(F.xxhash64("label_id"), "label_id").limit(2 * max_rows)
    found = picked(docs, doc_id="bigint", text="string").where(F.octet_length("text") <= MAX_BYTES)
    found = found.join(F.broadcast(ids.drop("z")), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(max_rows).collect()
    y = np.array([r.y for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return Model(None, None, float(y.mean()) if len(y) else 0.5)
    vectors = Vectors.learn([r.text for r in rows])
    x = np.array([vectors.pool(r.text) for r in rows], dtype=np.float64)
    apart = np.arange(len(rows)) % 4 == 3
    network = Network(x.shape[1]).fit(x[~apart], y[~apart])
    if len(set(y[apart])) == 2:
        network.calibrate(x[apart], y[apart])
    return Model(vectors, network, float(y.mean()))


def scored(docs: DataFrame, model: Model, keep_from: float | None = None, name: str = "score") -> DataFrame:
    """docs' rows with a further column of scores, or docs' rows of a score of keep_from at least, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vacated()
        model = shared.value
        try:
            for b in batches:
                found = model.score(pc.cast(b.column(at), pa.string()).to_pylist())
                if keep_from is not None:
                    yield b.filter(pa.array(found >= keep_from))
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "score"])
        finally:
            if model.vectors is not None:
                model.vectors.cache.clear()
                model.vectors.kinds.clear()
            released()

    if keep_from is not None:
        return plain.mapInArrow(go, plain.schema).toDF(*docs.columns)
    return plain.mapInArrow(go, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*docs.columns, name)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold."""
    return scored(docs, train(docs, labels), threshold)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = picked(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
