"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: an ordinary one of the
words that most ordinary documents hold, and a toxic one of what toxic
documents repeat and ordinary ones hardly know.  A text is cut into windows of
``WINDOW`` words, and every window of the whole text is compressed with the
ordinary dictionary alone and with both; what the toxic one saves is the
window's *saving*.  Windows whose saving reaches a level are counted at several
levels, and a logistic fit on labelled documents that the dictionaries haven't
seen calibrates the counts to a probability.

The dictionaries' content is chosen by document counts and loaded raw.
zstandard's own trainer was measured on the same windows and did worse (README).

Only the fit sees a bounded sample: at most ``MAX_TOXIC`` and ``MAX_ORDINARY``
labelled documents, the first in order of a hash of their ids, of at most
``MAX_TEXT`` bytes each.  Scoring is a narrow map over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words
from ledgerloom.llm.held import held

MAX_TOXIC, MAX_ORDINARY, MAX_TEXT = 2000, 4000, 32 << 10
WINDOW = 16
LEVELS = tuple(range(2, 12))
#: A marked word is in this share of toxic documents and that many times likelier there.
SUPPORT, LIKELIER = 0.01, 8
ORDINARY_BYTES, TOXIC_BYTES = 98_304, 4_096
TEXT_AT_ONCE = 2 << 20
LETTERS = re.compile(r"[^\W\d_]+")


class Windows:
    """The windows of whole texts in lower case, as places in one buffer: ``WINDOW`` words each with the blanks around them, the last of a text maybe fewer."""

    def __init__(self, texts: list[str]):
        data, starts, ends, bounds = words.parsed(pa.array([f" {t.lower()} " for t in texts], pa.large_string()))
        text = np.searchsorted(bounds[1:], starts, "right")
        self.words = np.bincount(text, minlength=len(texts))
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.words)])
        head = np.flatnonzero((np.arange(len(starts)) - first[text]) % WINDOW == 0)
        self.data, self.owner = data, text[head]
        self.begin, self.end = starts[head] - 1, ends[np.minimum(head + WINDOW, first[self.owner + 1]) - 1] + 1

    def sizes(self, compressor: zstandard.ZstdCompressor) -> np.ndarray:
        """Compressed bytes of each window by itself."""
        if not len(self.begin):
            return np.zeros(0, np.int64)
        places = np.stack([self.begin, self.end - self.begin], axis=1).astype("=u8")
        done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(self.data, places.tobytes()), threads=1)
        return np.fromiter(map(len, map(done.__getitem__, range(len(done)))), np.int64, len(done))


@dataclass(frozen=True)
class Model:
    """What executors need for a score; all of fixed size."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that knows the content and writes no more than a window's own bytes."""
    settings = zstandard.ZstdCompressionParameters(window_log=18, hash_log=18, chain_log=19, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
                                                   write_content_size=0, write_checksum=0, write_dict_id=0)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=known)


class Scorer:
    def __init__(self, model: Model):
        self.plain, self.both, self.weights = compressor(model.ordinary), compressor(model.ordinary + model.toxic), np.array(model.weights)

    def savings(self, found: Windows) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        return found.sizes(self.plain) - found.sizes(self.both)

    def features(self, texts: list[str]) -> np.ndarray:
        """A row a text: counts of windows whose saving reaches each level, and their shares."""
        found = Windows(texts)
        saved = self.savings(found)
        counts = np.stack([np.bincount(found.owner[saved >= level], minlength=len(texts)) for level in LEVELS], axis=1)
        return np.hstack([np.ones((len(texts), 1)), np.log1p(counts), 100 * counts / np.maximum(found.words, 50)[:, None]])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -50, 50)))


def scorer(model: Model) -> Scorer:
    return held(Scorer, model)


def apart(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones, so that a copied text doesn't vouch for its words."""
    seen: set = set()
    out = []
    for t in texts:
        ws = t.split()
        runs = np.array([hash_of(" ".join(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))], np.uint64)
        marks = {(k, int((runs * np.uint64(2 * k + 1000003) ^ (runs >> np.uint64(7 + k))).min())) for k in range(4)}
        if not marks & seen:
            out.append(t)
        seen |= marks
    return out


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


def marked(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Words that toxic documents share and ordinary ones lack, with how many hold them."""
    t, o = Counter(), Counter()
    for x in toxic:
        t.update(set(LETTERS.findall(x.lower())))
    for x in ordinary:
        o.update(set(LETTERS.findall(x.lower())) & t.keys())
    least = max(4, SUPPORT * len(toxic))
    return {w: n for w, n in sorted(t.items()) if len(w.encode()) > 2 and n >= least and n / len(toxic) > LIKELIER * (o[w] + 0.5) / len(ordinary)}


def content(size: int, held: Counter) -> bytes:
    """A dictionary's text: the words that most documents hold, the commonest last, where a match costs least."""
    out, n = [], 0
    for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0])):
        out.append(b" " + w + b" ")
        n += len(out[-1])
        if n >= size:
            break
    return b"".join(reversed(out))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first column is the constant."""
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """Train both dictionaries on two thirds of each list and calibrate on the rest; ``share`` is that of toxic rows."""
    part = lambda xs, k: [x for i, x in enumerate(xs) if (i % 3 == 2) == k]
    learn_t, learn_o = apart(part(toxic, False)), apart(part(ordinary, False))
    marks = marked(learn_t, learn_o) if learn_t and learn_o else {}
    calm = Model(b"", b"", (-4.0,) + (0.0,) * (2 * len(LEVELS)))
    if not marks:
        return calm
    common = Counter()
    for x in learn_o:
        common.update(set(x.lower().encode().split()))
    model = Model(content(ORDINARY_BYTES, Counter({w: n for w, n in common.items() if n > 2})), content(TOXIC_BYTES, Counter({w.encode(): n for w, n in marks.items()})), calm.weights)
    held_t, held_o = part(toxic, True), part(ordinary, True)
    if not held_t or not held_o:
        return calm
    s = Scorer(model)
    x = np.vstack([s.features((held_t + held_o)[i : i + 200]) for i in range(0, len(held_t + held_o), 200)])
    y = np.array([1.0] * len(held_t) + [0.0] * len(held_o))
    weight = np.where(y > 0, share / len(held_t), (1 - share) / len(held_o)) * len(y)
    return Model(model.ordinary, model.toxic, tuple(logistic(x, y, weight).tolist()))


def is_held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Fit on labelled rows that aren't held out; at most the two bounds of rows, of ``MAX_TEXT`` bytes each, leave the cluster.

    Several labels of one document count as toxic if one is; null labels and ids
    are ignored, and so are longer and null texts.  Of several texts under one
    id the first in order is learned from."""
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~is_held_out(F.col("doc_id")))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = rows.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_ordinary))
    some = some.withColumnRenamed("doc_id", "__id").withColumnRenamed("toxic", "__toxic")
    short = docs.select(F.col(id_col).alias("__d"), F.col(text_col).cast("string").alias("__t")).where(F.octet_length("__t") <= MAX_TEXT)
    got = short.join(F.broadcast(some), F.col("__d") == F.col("__id")).groupBy("__id", "__toxic").agg(F.min("__t").alias("t"))  # both bounds hold if ids repeat
    got = got.select(F.col("__toxic").alias("toxic"), F.xxhash64("__id").alias("h"), "__id", "t").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["__id"], r["t"]))
    share = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    return fit([r["t"] for r in got if r["toxic"] == 1], [r["t"] for r in got if r["toxic"] == 0], share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row from its text alone; empty and null texts score like any text without toxic windows.

    A model from too few labels to learn from scores every text alike and low;
    repeated rows, empty tables and further columns change nothing."""

    def run(batches):
        s = scorer(model)
        for batch in words.text_slices(batches, 1, TEXT_AT_ONCE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.scores([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of a table whose text scores below the threshold, with all their columns; one narrow pass."""
    place = docs.columns.index(text_col)

    def run(batches):
        s = scorer(model)
        for batch in batches:
            for part in words.text_slices([batch], place, TEXT_AT_ONCE):
                keep = s.scores([t or "" for t in part.column(place).to_pylist()]) < threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
