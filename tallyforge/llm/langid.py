"""Language identification with a convolutional network over bytes, in numpy.

Filters of several widths slide over fixed-length windows of a text's UTF-8 bytes, each
keeps its strongest response (max pooling), and a softmax layer names the language.
Case, digits and signs are folded away first. A text is cut into windows that together
hold all of it; its prediction is the mean of the windows' probabilities, weighted by
their letters.

For inference a filter of width w over one-hot bytes is a sum of table rows, and two
neighbouring bytes share one row: all filters together cost two table reads a byte.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, spread, stratified_rows

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
#: Bound of the training sample in rows (at least one a language); each is read whole.
SAMPLE_ROWS = 1200
EPOCHS = 5
_BATCH = 64


@functools.cache
def _not_letters() -> re.Pattern:
    """Runs of anything but letters (category L): ``\\w`` takes in signs such as a superscript two, so those are named besides."""
    return re.compile(f"[\\W\\d_{_numerals(0, 1 << 16)}]+")


@functools.cache
def _rare_numerals() -> re.Pattern:
    """Those beyond the basic plane: apart, since a class that spans planes is read one sign after the other."""
    return re.compile(f"[{_numerals(1 << 16, sys.maxunicode + 1)}]+")


def _numerals(low: int, high: int) -> str:
    return re.escape("".join(c for c in map(chr, range(low, high)) if c.isalnum() and not c.isalpha() and not c.isdecimal()))


def letters_only(text: str | None) -> str:
    """Lower case, every run of other characters than letters one blank."""
    text = (text or "").lower()
    if text and max(text) > "\uffff":
        text = _rare_numerals().sub(" ", text)
    return _not_letters().sub(" ", text).strip()


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All of ``raw`` as rows of ``size`` bytes, the last padded with zeros."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


def _padded(x: np.ndarray) -> np.ndarray:
    """Zeros behind each window, so that every filter begins at every byte, in training and in use."""
    return np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))


class ByteCnn:
    """conv: for each width an array (width, 256, FILTERS); dense: (filters, classes)."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    # ---- training
    def _forward(self, x: np.ndarray):
        pooled, where = [], []
        n = x.shape[1]
        x = _padded(x)
        for table, w in zip(self.conv, WIDTHS):
            z = sum(table[k][x[:, k : k + n]] for k in range(w))
            at = z.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1) + self.shift, 0)
        s = h @ self.dense + self.offset
        e = np.exp(s - s.max(1, keepdims=True))
        return h, where, e / e.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy; gradients pass the pooling at its maxima only."""
        rng = np.random.default_rng(seed)
        values = [*self.conv, self.shift, self.dense, self.offset]
        m1, m2 = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), _BATCH):
                pick = order[lo : lo + _BATCH]
                xb, n = x[pick], len(pick)
                wide = _padded(xb)
                h, where, p = self._forward(xb)
                g = p.copy()
                g[np.arange(n), y[pick]] -= 1
                g /= n
                gh = (g @ self.dense.T) * (h > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    gk = np.zeros_like(self.conv[k])
                    part = gh[:, k * FILTERS : (k + 1) * FILTERS]
                    columns = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for j in range(w):
                        np.add.at(gk[j], (wide[np.arange(n)[:, None], where[k] + j], columns), part)
                    grads.append(gk)
                grads += [gh.sum(0), h.T @ g, g.sum(0)]
                step += 1
                for v, d, a, b in zip(values, grads, m1, m2):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        self.tables = None

    # ---- inference
    def _compile(self) -> tuple[np.ndarray, np.ndarray]:
        if self.tables is None:
            first, second = np.divmod(np.arange(65536), 256)  # two neighbouring bytes
            zero = np.zeros((65536, FILTERS), np.float32)
            c2, c3, c4 = self.conv
            head = np.concatenate([c[0][first] + c[1][second] for c in (c2, c3, c4)], 1)
            tail = np.concatenate([zero, c3[2][first], c4[2][first] + c4[3][second]], 1)
            self.tables = (head, tail)
        return self.tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window (rows of bytes)."""
        head, tail = self._compile()
        out = np.empty((len(x), len(self.classes)), np.float32)
        for lo in range(0, len(x), 256):
            xb = np.pad(_padded(x[lo : lo + 256]), ((0, 0), (0, 1))).astype(np.int32)
            pairs = xb[:, :-1] << 8 | xb[:, 1:]
            n = x.shape[1]
            z = head[pairs[:, :n]]
            z += tail[pairs[:, 2 : n + 2]]
            h = np.maximum(z.max(1) + self.shift, 0)
            s = h @ self.dense + self.offset
            e = np.exp(s - s.max(1, keepdims=True))
            out[lo : lo + 256] = e / e.sum(1, keepdims=True)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); (und, 0.0) without any letter."""
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[np.ndarray] = []
        of: list[int] = []
        sums = np.zeros((len(texts), len(self.classes) + 1))

        def done() -> None:
            x = np.concatenate(held)
            letters = ((x != 32) & (x != 0)).sum(1)
            p = self.probabilities(x)
            np.add.at(sums, np.array(of), np.c_[p * letters[:, None], letters])
            held.clear()
            of.clear()

        for k, text in enumerate(texts):
            raw = letters_only(text).encode("utf-8", "replace")
            if not raw or not self.classes:
                continue
            for at in range(0, len(raw), WINDOW * 8192):
                w = windows(raw[at : at + WINDOW * 8192])
                held.append(w)
                of += [k] * len(w)
                if len(of) >= 8192:
                    done()
        if held:
            done()
        for k in np.flatnonzero(sums[:, -1] > 0):
            p = sums[k, :-1] / sums[k, -1]
            best = int(p.argmax())
            out[k] = (self.classes[best], float(min(1.0, max(0.0, p[best]))))
        return out


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> ByteCnn:
    """The network trained on all windows of the texts."""
    classes = sorted(set(langs))
    net = ByteCnn(classes)
    raws = [(letters_only(text).encode("utf-8", "replace"), classes.index(lang)) for text, lang in zip(texts, langs)]
    found = [(windows(raw), y) for raw, y in raws if raw]
    if len(classes) > 1 and found:
        net.train(np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), y) for x, y in found]), epochs)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> ByteCnn:
    """Fits on a bounded, hash-chosen sample: up to ``rows`` rows (one a language at least), shared evenly by the languages, outside the held-out fold."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.coalesce(fold_of(id_col, folds) != held_out, F.lit(False)))
    picked = stratified_rows(known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", "lang", rows)
    return fit([r.text for r in picked], [r.lang for r in picked])


def identify_language(docs: DataFrame, net: ByteCnn, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (and the ``keep`` columns), lang_pred and score in 0..1 for every row.

    ``und`` with score 0 where the text is null, empty or has no letter. Texts are read
    whole; null and repeated ids keep their rows.
    """
    names = [id_col, *[c for c in (keep or []) if c != id_col]]
    fields = [docs.schema[c] for c in names]
    inner = [f"c{k}" for k in range(len(names))]  # the caller's names cannot clash with those used here
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(names, inner)], F.col(text_col).cast("string").alias("text"))
    net.tables = None  # compiled on the workers; the pickled network stays small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = net.predict_batch(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*inner, "lang_pred", "score"])

    fields = [T.StructField(i, f.dataType) for i, f in zip(inner, fields)]
    out = spread(rows).mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.toDF(*names, "lang_pred", "score")
