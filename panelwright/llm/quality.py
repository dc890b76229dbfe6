"""Quality by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import small_side
from panelwright.llm.words import _STEP, _U, VALUE, Words, mixed, slices
from panelwright.session import materialise

#: Beginnings of words, in bytes, that are features besides the words.
BEGINNINGS = (4, 5)
#: Numbers of text features, hashed words first, then 16 steps for each of the text's figures.
FIGURES = 8
TEXT_FEATURES = 1 << 16
WORDS = TEXT_FEATURES - 16 * FIGURES
META_FEATURES = 1 << 12

#: Labelled documents that are fitted on at most.
MAX_LABELLED = 8_000
ROUNDS = 2
#: Share of the unlabelled documents that a view is most confident of, for each class.
CONFIDENT = 0.05
#: Steps of a fit with pseudo-labels, each a pass of Spark over them, and numbers in one of its rows.
STEPS = 10
SLOTS = 4096
#: Weight of the squared weights against the mean loss, times the number of documents.
L2 = 1.0
ROWS_AT_ONCE = 500


def _beginnings(words: Words) -> list[np.ndarray]:
    """Hashes of the first four and five bytes of each word, for inflected forms."""
    total, out = np.zeros(len(words.starts), dtype=_U), []
    for k in range(max(BEGINNINGS)):
        at = words.starts + k
        inside = at < words.stops
        total = total * _STEP + np.where(inside, VALUE[words.data[np.where(inside, at, 0)]], _U(0))
        if k + 1 in BEGINNINGS:
            out.append(total + _U(k))
    return out


def text_features(texts: pa.Array) -> pa.Array:
    """Feature numbers of each text, packed in two bytes each: distinct hashed words, and steps of eight
    figures (words, word length, capitals, digits, signs, distinct words, line ends, beyond ASCII)."""
    parts, sizes = [], []
    for start, stop, words in slices(texts):
        n = stop - start
        counts = np.diff(words.first)
        rows = np.repeat(np.arange(n), counts)
        parts_of_words = [words.hashes ^ _STEP, *_beginnings(words)]
        features = np.concatenate([(mixed(h) % _U(WORDS)).astype(np.int64) for h in parts_of_words])
        seen = np.unique(np.tile(rows, len(parts_of_words)) * WORDS + features)
        rows, features = seen // WORDS, seen % WORDS
        data, size = words.data, np.maximum(np.diff(words.offsets), 1)

        def share(mask, words=words, size=size):
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[words.offsets[1:]] - total[words.offsets[:-1]]) / size

        distinct = np.bincount(rows, minlength=n) / np.maximum(2 * counts, 1)
        upper = (data >= 0x41) & (data <= 0x5A)
        signs = (data > 0x20) & (data < 0x7F) & ~upper
        signs &= ~((data >= 0x30) & (data <= 0x39)) & ~((data >= 0x61) & (data <= 0x7A))
        figures = [
            np.log2(counts + 1) / 20, np.diff(words.offsets) / np.maximum(counts, 1) / 16, share(upper), share((data >= 0x30) & (data <= 0x39)) * 4,
            share(signs) * 2, distinct, share(data == 0x0A) * 8, share(data >= 0x80) * 4,
        ]
        steps = np.stack([WORDS + 16 * i + np.minimum((f * 16).astype(np.int64), 15) for i, f in enumerate(figures)], axis=1)
        rows = np.concatenate([rows, np.repeat(np.arange(n), FIGURES)])
        features = np.concatenate([features, steps.reshape(-1)])
        parts.append(features[np.argsort(rows, kind="stable")].astype(np.uint16))
        sizes.append(np.bincount(rows, minlength=n))
    if not parts:
        return pa.array([], pa.binary())
    packed = np.concatenate(parts)
    offsets = np.concatenate([[0], 2 * np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def meta_features(values: list[Column]) -> Column:
    """A hashed feature per column, null included; numbers by their power of two."""
    return F.array(*[
        F.pmod(F.xxhash64(F.lit(i), F.coalesce(value.cast("string"), F.lit("-"))), F.lit(META_FEATURES)).cast("int")
        for i, value in enumerate(values)
    ])


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, start of each row) of an array of lists or of packed features."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if pa.types.is_list(lists.type):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    _, where, content = lists.buffers()
    offsets = np.frombuffer(where, np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64) // 2
    packed = np.frombuffer(content, np.uint16, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint16)
    return packed[offsets[0] :], offsets - offsets[0]


def _margins(weights: np.ndarray, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[features])])
    return weights[-1] + total[first[1:]] - total[first[:-1]]


def _scores(weights: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Margins of a whole batch, some rows at a time, so that temporary arrays stay small."""
    parts = [_margins(weights, *_rows(lists.slice(i, ROWS_AT_ONCE))) for i in range(0, len(lists), ROWS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(w, features, first, rows, target) -> tuple[float, np.ndarray]:
    """Sum of the logistic losses of some documents, targets between 0 and 1, and its slope."""
    m = _margins(w, features, first)
    error = _sigmoid(m) - target
    slope = np.append(np.bincount(features, error[rows], minlength=len(w) - 1), error.sum())
    return float((np.logaddexp(0, m) - target * m).sum()), slope


def pseudo_loss(learned: DataFrame, view: str):
    """A function of weights: sum of the losses of all rows (``view``, said) and its slope, added up by Spark."""
    spark = learned.sparkSession

    def at(w):
        shared = spark.sparkContext.broadcast(w)

        def part(batches):
            weights, value, slope = shared.value, 0.0, np.zeros(len(shared.value))
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                    some = batch.slice(i, ROWS_AT_ONCE)
                    features, first = _rows(some.column(0))
                    rows = np.repeat(np.arange(some.num_rows), np.diff(first))
                    more, change = _loss(weights, features, first, rows, some.column(1).to_numpy(zero_copy_only=False))
                    value, slope = value + more, slope + change
            whole = np.append(slope, value)
            pieces = [whole[i : i + SLOTS] for i in range(0, len(whole), SLOTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["i", "numbers"]
            )

        def added(table: pa.Table) -> pa.Table:
            numbers = table.column("numbers").combine_chunks()
            total = numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1).sum(axis=0)
            return pa.table({"i": table.column("i").slice(0, 1), "numbers": pa.array([total], pa.list_(pa.float64()))})

        kind = "i int, numbers array<double>"
        sums = learned.select(view, "said").mapInArrow(part, kind).groupBy("i").applyInArrow(added, kind).toArrow().sort_by("i")
        shared.destroy()
        whole = sums.column("numbers").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return whole[-1], whole[:-1]

    return at


def fit(
    features: np.ndarray, first: np.ndarray, good: np.ndarray, n_features: int, steps: int = 60, start: np.ndarray | None = None, more=None
) -> np.ndarray:
    """Weights (the last is the offset) of a logistic model of binary features, by L-BFGS.

    ``more`` is (number of pseudo-labelled documents, function of weights with the sum of their losses
    and its slope, weight of all of them against that of all labels).
    """
    rows = np.repeat(np.arange(len(good), dtype=np.int32), np.diff(first))
    shrink = L2 / len(good)

    def loss(w):
        value, slope = _loss(w, features, first, rows, good)
        value, slope = value / len(good), slope / len(good)
        if more:
            taught, change = more[1](w)
            value = (value + more[2] * taught / more[0]) / (1 + more[2])
            slope = (slope + more[2] * change / more[0]) / (1 + more[2])
        slope[:-1] += shrink * w[:-1]
        return value + shrink / 2 * (w[:-1] ** 2).sum(), slope

    w = np.zeros(n_features + 1) if start is None else start
    value, slope = loss(w)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, used = -slope, []
        for s, y in reversed(history):
            a = (s @ way) / (s @ y)
            used.append(a)
            way = way - a * y
        if history:
            s, y = history[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(history, reversed(used), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        length = 1.0 if history else 1.0 / max(np.abs(slope).sum(), 1e-12)
        for _ in range(30):
            new_value, new_slope = loss(w + length * way)
            if new_value <= value + 1e-4 * length * (way @ slope):
                break
            length /= 2
        else:
            break
        s, y = length * way, new_slope - slope
        w = w + s
        if s @ y > 1e-12:
            history = [*history[-6:], (s, y)]
        done = value - new_value < 1e-6 * value
        value, slope = new_value, new_slope
        if done:
            break
    return w


def _scaled(margins: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Offset and factors of a logistic model of a few margins (columns), fitted by Newton steps."""
    x = np.column_stack([np.ones(len(good)), margins])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (good - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _knowledge(margins: np.ndarray, scale: np.ndarray, good: np.ndarray) -> float:
    """Share of the uncertainty about held-out labels that a calibrated view takes away, 0 to 1."""
    m, rate = scale[0] + scale[1] * margins, good.mean()
    left = (np.logaddexp(0, m) - good * m).mean()
    return float(np.clip(1 - left / -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate)), 0, 1))


@dataclass
class Model:
    """Weights of both views, their calibration, that of both together, and the least good score."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both_scale: np.ndarray
    threshold: float
    rounds: list[dict]


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best accuracies of both classes, that of good documents counted twice,
    midway between neighbours."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept = 1 - np.concatenate([[0], np.cumsum(g)]) / max(g.sum(), 1)
    gone = np.concatenate([[0], np.cumsum(1 - g)]) / max((1 - g).sum(), 1)
    value = 2 * kept + gone
    value[1:-1][s[1:] == s[:-1]] = -1
    best = int(np.argmax(value))
    low = s[best - 1] if best else 0.0
    high = s[best] if best < len(s) else 1.0
    return float((low + high) / 2)


def truths(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(label_id, good): 0 if any label says low quality or toxic, 1 if quality is good and none
    says so; documents with neither are left out, null ids too."""
    found = labels.groupBy(F.col(id).cast("long").alias("label_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = F.when(F.coalesce(bad, F.lit(False)), 0).when(F.col("quality") == 1, 1)
    return found.select("label_id", good.alias("good")).filter("label_id is not null and good is not null")


def _sample(df: DataFrame, n: int, most: int) -> pa.Table:
    """At most so many of n rows, those whose hash is below a bound; nothing is sorted."""
    if n > most:
        bound = int(0.95 * most / n * (1 << 30))
        df = df.filter(F.pmod("place", F.lit(1 << 30)) < bound)
    return df.limit(most).toArrow()


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    meta: list[Column] | None = None,
    rounds: int = ROUNDS,
    max_labelled: int = MAX_LABELLED,
    confident: float = CONFIDENT,
) -> Model | None:
    """Co-train both views; None if there are not at least ten labelled documents of each class.

    A bounded sample of labelled documents (``max_labelled``, by their hashes) is split: 70% to fit, 30% to calibrate. In each round both views score every unlabelled document,
    and each view then learns, besides the labels, all those of which the other view is most
    confident: the share ``confident`` with its highest scores and that with its lowest ones, ties
    included. The other view's calibrated probability is what they are taught, and all of them weigh as
    much against the labels as the share of the held-out uncertainty that the other view takes away, so
    that a view that knows little teaches little. Repeated rows count each; columns of ``labels`` and ``docs``
    may have any names.
    """
    meta = meta or default_meta(docs)
    view = docs.select(
        F.col(id).cast("long").alias("doc"),
        F.arrow_udf(text_features, "binary")(F.col(text)).alias("words"),
        meta_features(meta).alias("meta"),
        F.xxhash64(F.col(id), F.col(text)).alias("place"),
    )
    truth = materialise(truths(labels, id))
    view = view.join(small_side(truth), F.col("doc") == F.col("label_id"), "left").drop("label_id", "doc")
    view = materialise(view)
    labelled = view.filter("good is not null")
    known = _sample(labelled, labelled.count(), max_labelled)
    good = known.column("good").to_numpy().astype(float)
    if min(good.sum(), len(good) - good.sum()) < 10:
        return None
    place = known.column("place").to_numpy()
    held = mixed(place.view(_U)) % _U(10) < 3
    data = {c: _rows(known.column(c)) for c in ("words", "meta")}
    size = {"words": TEXT_FEATURES, "meta": META_FEATURES}
    spark = docs.sparkSession
    taught: dict[str, tuple | None] = {"words": None, "meta": None}
    report, weights = [], {}
    for number in range(rounds + 1):
        scales, margins = {}, {}
        for c in data:
            features, first = data[c]
            keep = np.repeat(~held, np.diff(first))
            starts = np.concatenate([[0], np.cumsum(np.diff(first)[~held])])
            if not number or taught[c]:
                steps = STEPS if number else 60
                weights[c] = fit(features[keep], starts, good[~held], size[c], steps, weights.get(c), taught[c])
            margins[c] = _margins(weights[c], features, first)
            scales[c] = _scaled(margins[c][held, None], good[held])
        report.append({"round": number} | {
            f"{name}_{c}": taught[c][i] if taught[c] else 0 for c in taught for name, i in (("pseudo", 0), ("weight", 2))
        })
        if number == rounds:
            break
        shared = spark.sparkContext.broadcast((weights, scales))
        scored = view.filter("good is null").select(*data, *[
            F.arrow_udf(_score_one(shared, c), "double")(F.col(c)).alias(f"p_{c}") for c in data
        ])
        ends = dict(zip(data, scored.approxQuantile([f"p_{c}" for c in data], [confident, 1 - confident], 0.001), strict=True))
        if not all(ends.values()):
            continue  # nothing is unlabelled
        sure = {c: (F.col(f"p_{c}") <= ends[c][0]) | (F.col(f"p_{c}") >= ends[c][1]) for c in data}
        # Scoring twice is cheap; only what one of the views is sure of is written.
        chosen = materialise(scored.filter(sure["words"] | sure["meta"]))
        for c, other in (("meta", "words"), ("words", "meta")):
            learned = chosen.filter(sure[other]).select(c, F.col(f"p_{other}").alias("said"))
            knows = _knowledge(margins[other][held], scales[other], good[held])
            taught[c] = (learned.count(), pseudo_loss(learned, c), knows)
    both = np.column_stack([margins["words"], margins["meta"]])
    both_scale = _scaled(both[held], good[held])
    scores = _sigmoid(both_scale[0] + both[held] @ both_scale[1:])
    return Model(
        weights["words"], weights["meta"], scales["words"], scales["meta"], both_scale, _threshold(scores, good[held]), report
    )


def _score_one(shared, view: str):
    def score(lists: pa.Array) -> pa.Array:
        weights, scales = shared.value
        return pa.array(_sigmoid(scales[view][0] + scales[view][1] * _scores(weights[view], lists)))

    return score


def default_meta(docs: DataFrame) -> list[Column]:
    """lang, source, quarters of the power of two of n_chars and every two of these, as far as the table has them."""
    found = [F.col(c).cast("string") for c in ("lang", "source") if c in docs.columns]
    if "n_chars" in docs.columns:
        found.append(F.floor(4 * F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)) + 1)).cast("string"))
    known = [F.coalesce(c, F.lit("-")) for c in found]
    return found + [F.concat_ws("\t", *two) for two in combinations(known, 2)] or [F.lit("")]


def scored(docs: DataFrame, model: Model | None, text: str = "text", meta: list[Column] | None = None) -> DataFrame:
    """``docs`` with text_score, meta_score, score and accepted; columns of these names are replaced.

    Every row is scored on its own, repeated rows and null texts included. Without a model all
    scores are 1 and every document is accepted.
    """
    if model is None:
        one = F.lit(1.0)
        return docs.withColumns({"text_score": one, "meta_score": one, "score": one, "accepted": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.text, model.meta, model.text_scale, model.meta_scale, model.both_scale)
    )

    def score(texts: pa.Array, metas: pa.Array) -> pa.Array:
        text_weights, meta_weights, text_scale, meta_scale, both = shared.value
        parts = [
            _scores(text_weights, text_features(texts.slice(i, ROWS_AT_ONCE))) for i in range(0, len(texts), ROWS_AT_ONCE)
        ]
        one = np.concatenate(parts) if parts else np.zeros(0)
        two = _scores(meta_weights, metas)
        values = [
            text_scale[0] + text_scale[1] * one, meta_scale[0] + meta_scale[1] * two, both[0] + both[1] * one + both[2] * two,
        ]
        return pa.StructArray.from_arrays([pa.array(_sigmoid(v)) for v in values], ["text_score", "meta_score", "score"])

    kind = "struct<text_score:double,meta_score:double,score:double>"
    found = F.arrow_udf(score, kind)(F.col(text), meta_features(meta or default_meta(docs)))
    out = docs.withColumn("_pw_scores", found)
    names = ("text_score", "meta_score", "score")
    out = out.withColumns({c: F.col(f"_pw_scores.{c}") for c in names})
    return out.withColumn("accepted", F.col("score") >= model.threshold).drop("_pw_scores")
