"""Quality classifier by co-training on two views: the text, and the page's metadata.

The text's view has counts of characters and words beside hashed words and word pairs. Each view has its own logistic model. In every round each model labels the unlabelled documents of which it is
sure, and these join the other model's training rows. In the end both are calibrated on held-out labels and their
log odds are added.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sums, text_slices, word_hashes, written

#: Labelled rows that are fitted at most, pseudo-labels that a view hands over per round and class at most. Which ones they are
#: goes by the hash of the id; the search for pseudo-labels and the scores cover all rows.
FIT_ROWS, PSEUDO_ROWS, ROUNDS, SURE = 20_000, 2_000, 3, 0.97
#: Buckets of the metadata view's hashed values; of the text view's hashed words and word pairs, and these buckets' ridge. It is
#: strong, so that few labels teach counts of characters before words.
META, WORDS, WORD_RIDGE = 128, 128, 30.0


def _class(data: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table[data]


TEXT_FEATURES = ("words", "upper", "digits", "symbols", "bangs", "bars", "stops", "distinct", "repeats", "word length", "lines", "wide")
TEXT = len(TEXT_FEATURES) + WORDS


def word_features(h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words and pairs of neighbours hashed into WORDS signed buckets, over the root of their number."""
    before = np.r_[np.zeros(min(1, len(h)), np.uint64), h[:-1]]
    words = np.diff(first)
    before[first[:-1][words > 0]] = 0
    out = np.zeros(len(words) * WORDS)
    for grams in (h, mix(h * np.uint64(0x9FB21C651E98DF25) + before)):
        code = rows * WORDS + (grams % np.uint64(WORDS)).astype(np.int64)
        out += np.bincount(code, weights=1.0 - 2.0 * ((grams >> np.uint64(32)) & np.uint64(1)), minlength=len(out))
    return out.reshape(-1, WORDS) / np.sqrt(np.maximum(2 * words, 1))[:, None]


def text_features(column: pa.Array):
    """Rows of TEXT_FEATURES and word_features (float16) for the texts of a column, some rows at a time; an empty text has zeros."""
    for at, end, data, offsets in text_slices(column):
        n = np.diff(offsets).astype(float)
        h, first = word_hashes(data, offsets)
        words = np.diff(first).astype(float)
        rows = np.repeat(np.arange(end - at), np.diff(first))
        same = np.zeros(len(h), np.int64)
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        order = np.lexsort((h, rows))
        new = np.ones(len(h), np.int64)
        if len(h) > 1:
            new[1:] = (h[order][1:] != h[order][:-1]) | (rows[1:] != rows[:-1])
        of = lambda chars: sums(_class(data, chars), offsets).astype(float)
        upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
        w, b = np.maximum(words, 1), np.maximum(n, 1)
        wide = sums((data > 127).astype(np.int64), offsets).astype(float)
        share = lambda x: np.log1p(100 * x)
        counts = np.stack([
            np.log1p(words), share(upper / np.maximum(upper + lower, 1)), share(of("0123456789") / b), share(of("#$%&*+<=>@^_~\\/") / b), share(of("!") / w), share(of("|") / w),
            share(of(".,;:") / w), sums(new, first) / w, share(sums(same, first) / w), np.log1p(n / w), share(of("\n") / w), share(wide / b),
        ], axis=1)
        yield at, end, np.concatenate([counts, word_features(h, first, rows)], axis=1).astype(np.float16)


def meta_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed one-hot values of language, source and the length's power of two. Each distinct value is hashed once."""
    out = np.zeros((len(lang), META), np.uint8)
    size = np.frexp(np.maximum(pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False), 0).astype(float))[1]
    for kind, column in enumerate((lang, source, pa.array(size, pa.int64()))):
        code = column.dictionary_encode()
        known = code.dictionary.to_pylist()
        bucket = np.array([int.from_bytes(hashlib.blake2b(f"{kind}:{v}".encode(), digest_size=8).digest(), "little") % META for v in (*known, None)])
        out[np.arange(len(out)), bucket[pc.fill_null(code.indices, len(known)).to_numpy(zero_copy_only=False)]] = 1
    return out


@dataclass
class Logistic:
    """Standardised ridge logistic regression by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.ones((len(x), x.shape[1] + 1))
        np.clip((x - mean) / scale, -8, 8, out=z[:, :-1])
        ridge = np.broadcast_to(ridge, x.shape[1])
        beta = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            g = z.T @ (p - y) + np.r_[ridge * beta[:-1], 0]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(np.r_[ridge, 1e-6]), g)
            beta -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.beta[:-1] + self.beta[-1], -30, 30)


@dataclass
class QualityModel:
    """Two calibrated views; without labels of both classes every probability is the prior's and all is kept."""

    text: Logistic | None
    meta: Logistic | None
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        a = self.text.logit(text) * self.text_scale[0] + self.text_scale[1]
        b = self.meta.logit(meta) * self.meta_scale[0] + self.meta_scale[1]
        return a, b, a + b - self.prior


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    # targets drawn in a little, so that a perfect split stays finite
    one = Logistic.fit(logit[:, None], np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)))
    a = float(one.beta[0] / one.scale[0])
    return max(a, 0.0), float(one.beta[1] - one.mean[0] * one.beta[0] / one.scale[0]) if a > 0 else float(one.beta[1])


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text_view, lang, source, n_chars) of all rows; text_view is a row of text_features as bytes."""

    def run(batches):
        for batch in batches:
            for at, end, x in text_features(batch.column(1)):
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (2 * TEXT)), pa.py_buffer(x)])
                some = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([some.column(0), packed, *(some.column(i) for i in (2, 3, 4))], ["id", "text_view", "lang", "source", "n_chars"])

    rows = docs.select(F.col(id_col).cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return rows.mapInArrow(run, "id long, text_view binary, lang string, source string, n_chars long")


def _matrix(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: x.combine_chunks() if isinstance(x := rows.column(rows.schema.get_field_index(c)), pa.ChunkedArray) else x
    packed = np.concatenate([np.zeros(0, np.uint8), *(data for _, _, data, _ in text_slices(column("text_view")))])
    return packed.view(np.float16).reshape(-1, TEXT), meta_features(column("lang"), column("source"), column("n_chars"))


def _collected(rows: DataFrame) -> pa.Table:
    """A bounded number of rows on the driver. They are written first, so that tasks hand their candidates to one another and not to
    the driver; and they come as rows, since Arrow's pooled memory would stay with the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.Table.from_pylist([r.asDict() for r in written(rows).collect()], to_arrow_schema(rows.schema))


def cotrain(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, pseudo_rows: int = PSEUDO_ROWS, rounds: int = ROUNDS, sure: float = SURE) -> QualityModel:
    """The model from a feature table and labels (id_col, label_col 0 or 1). Other labels and nulls are ignored."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    order = F.xxhash64("id", F.lit(11))
    # one join tells labelled rows from the others, for all rounds
    marked = written(table.join(known, "id", "left"))
    got = _collected(marked.where("y is not null").orderBy(order, "id").limit(fit_rows))
    y = got["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, None)
    text, meta = _matrix(got)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(y), bool)
    fit = ~held if not held.all() else held
    sets = {"text": [(text[fit], y[fit])], "meta": [(meta[fit], y[fit])]}
    spark = table.sparkSession
    unlabelled = marked.where("y is null").drop("y")
    rate = (y.sum() + 1) / (len(y) + 2)
    text_ridge = np.r_[np.ones(len(TEXT_FEATURES)), np.full(WORDS, WORD_RIDGE)]
    for r in range(rounds + 1):
        of_text, of_meta = (Logistic.fit(np.concatenate([x for x, _ in sets[v]]), np.concatenate([t for _, t in sets[v]]), ridge) for v, ridge in (("text", text_ridge), ("meta", 1.0)))
        # calibrated on held-out labels, a view that knows little is never sure and teaches nothing
        model = QualityModel(of_text, of_meta, _platt(of_text.logit(text[held]), y[held]), _platt(of_meta.logit(meta[held]), y[held]), float(np.log(rate / (1 - rate))))
        if r == rounds:
            return model
        now = spark.sparkContext.broadcast(model)

        def run(batches, now=now):
            for batch in batches:
                if batch.num_rows:
                    a, b, _ = now.value.logits(*_matrix(batch))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(a)), pa.array(_sigmoid(b))], [*batch.schema.names, "p_text", "p_meta"])

        sets = {"text": sets["text"][:1], "meta": sets["meta"][:1]}
        scored = written(unlabelled.mapInArrow(run, "id long, text_view binary, lang string, source string, n_chars long, p_text double, p_meta double")
                         .where((F.col("p_text") >= sure) | (F.col("p_text") <= 1 - sure) | (F.col("p_meta") >= sure) | (F.col("p_meta") <= 1 - sure)))
        for teacher, pupil in (("p_text", "meta"), ("p_meta", "text")):
            for value, which in ((1.0, F.col(teacher) >= sure), (0.0, F.col(teacher) <= 1 - sure)):
                rows = _collected(scored.where(which).orderBy(F.xxhash64("id", F.lit(13 + r)), "id").limit(pseudo_rows))
                if rows.num_rows:
                    sets[pupil].append((_matrix(rows)[pupil == "meta"], np.full(rows.num_rows, value)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """(id_col, p_text, p_meta, p_quality, keep), one row per row of docs (id_col, text, lang, source, n_chars).

    p_text and p_meta are each view's calibrated probability of quality 1, p_quality their combination, keep whether it is at least
    threshold. Null texts are empty texts, null metadata a value of its own; repeated rows are scored alike; labels of
    unknown ids are ignored. Without labels of both classes nothing can be learnt: all probabilities are 0.5 and all rows are kept.
    Other columns are not read."""
    table = written(features(docs, id_col))
    now = docs.sparkSession.sparkContext.broadcast(cotrain(table, labels, id_col, **options))

    def run(batches):
        for batch in batches:
            a, b, c = now.value.logits(*_matrix(batch))
            p = _sigmoid(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(a)), pa.array(_sigmoid(b)), pa.array(p), pa.array(p >= threshold)], [id_col, "p_text", "p_meta", "p_quality", "keep"])

    return table.mapInArrow(run, f"`{id_col}` long, p_text double, p_meta double, p_quality double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that quality_scores keeps, with all their columns: the model is broadcast and no text is shuffled."""
    now = docs.sparkSession.sparkContext.broadcast(cotrain(written(features(docs, id_col)), labels, id_col, **options))
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(at[c])
            keep = np.zeros(batch.num_rows, bool)
            for a, b, x in text_features(column("text").cast(pa.string())):
                meta = meta_features(*(column(c).slice(a, b - a) for c in ("lang", "source", "n_chars")))
                keep[a:b] = _sigmoid(now.value.logits(x, meta)[2]) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
