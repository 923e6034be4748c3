"""Operator 9: a quality classifier, naive Bayes support vectors.

Indicators of word and shape n-grams, hashed into a fixed number of buckets, are scaled by the log ratio
of the two classes' document counts; a linear hinge-loss model is fitted on them by dual coordinate
descent, and a logistic curve through held-back margins turns a margin into a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_text, numbered

BITS = 18
#: Labelled rows that the hinge-loss model is fitted on, about; counts cover all labelled rows.
MAX_FIT_ROWS = 8_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def _shapes(raw: bytes) -> list[bytes]:
    """Words with letters as a or A, digits as 0, and each run of one sign as one."""
    x = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    return x[np.concatenate([[True], x[1:] != x[:-1]])].tobytes().split() if len(x) else []


def _grams(h: np.ndarray, salt: int) -> np.ndarray:
    one = (h ^ np.uint64(salt)) * _MULT
    return np.concatenate([one, (one[:-1] + (one[1:] >> np.uint64(7))) * _MULT])


def features(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the distinct buckets of its n-grams (one and two); none for no words.

    N-grams run over words, over their shapes, and over marks of whether a word repeats the one before it.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts = [x for raw in raws for x in (raw.lower().split(), _shapes(raw))]
    h = pd.util.hash_array(np.array([w for p in parts for w in p], dtype=object), categorize=False)
    ends = np.cumsum([0] + [len(p) for p in parts])
    shift, out = np.uint64(64 - BITS), []
    for i in range(0, len(parts), 2):
        words, shapes = h[ends[i] : ends[i + 1]], h[ends[i + 1] : ends[i + 2]]
        same = (words[1:] == words[:-1]).astype(np.uint64) + np.uint64(1)
        out.append(np.unique(np.concatenate([_grams(words, 1), _grams(shapes, 2), _grams(same, 3)]) >> shift).astype(np.int32))
    return out


def log_count_ratio(good: np.ndarray, bad: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = good + alpha, bad + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, *, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Weights over scaled indicators, rows of unit length; dual coordinate descent with a bias bucket at the end.

    Costs are weighted so that both classes count alike.
    """
    w, a = np.zeros(len(r) + 1), np.zeros(len(rows))
    xs = [_row(f, r) for f in rows]
    norm = np.array([v @ v for _, v in xs])
    share = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    most = np.where(y > 0, cost * len(y) / (2 * share[0]), cost * len(y) / (2 * share[1]))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(xs)):
            f, v = xs[i]
            new = min(max(a[i] - (y[i] * (w[f] @ v) - 1) / norm[i], 0.0), most[i])
            if (step := new - a[i]) != 0:
                w[f] += step * y[i] * v
                a[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _row(f: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = r[f]
    return np.append(f, np.int32(len(r))).astype(np.int32), np.append(v / max(np.sqrt(v @ v), 1e-12), 1.0).astype(np.float32)


def margin(f: np.ndarray, r: np.ndarray, w: np.ndarray) -> float:
    at, v = _row(f, r)
    return float(w[at] @ v)


def fit_logistic(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's curve by Newton steps, with his smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (t - p))
        b = b + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


class Model:
    """Log-count ratios, weights and the curve; at most a few MB, whatever the input."""

    def __init__(self, r: np.ndarray, w: np.ndarray, curve: tuple[float, float]):
        self.r, self.w, self.curve = r.astype(np.float32), w.astype(np.float32), curve

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = np.array([margin(f, self.r, self.w) for f in features(texts)])
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * m + self.curve[1], -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> Model:
    """The curve comes from margins of two models, each over the half it has not seen; the model from all."""
    if len(rows) == 0 or len(set(y)) < 2:  # one class or nothing to learn from: its smoothed share
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(r, np.zeros(len(r) + 1), (0.0, float(np.log(share / (1 - share)))))
    half = np.arange(len(rows)) % 2 == 0
    m = np.zeros(len(rows))
    for own in (half, ~half):
        if len(set(y[own])) == 2:
            w = fit_hinge([rows[i] for i in np.flatnonzero(own)], y[own], r)
            m[~own] = [margin(rows[i], r, w) for i in np.flatnonzero(~own)]
    return Model(r, fit_hinge(rows, y, r), fit_logistic(m, y))


_STATS = "kind int, bucket int, good long, bad long, key long, label int, grams array<int>"


def _gather(text_col: str, label_col: str):
    """Counts by bucket and class, summed within the task, and the sampled rows' features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                found, labels = features(part[text_col].tolist()), part[label_col].to_numpy()
                for f, label in zip(found, labels, strict=True):
                    counts[label][f] += 1
                    seen[label] += 1
                keep = np.flatnonzero(part["_sampled"].to_numpy())
                if len(keep):
                    yield pd.DataFrame(
                        {"kind": 1, "bucket": None, "good": None, "bad": None, "key": part["_key"].to_numpy()[keep], "label": labels[keep], "grams": [found[i] for i in keep]}
                    ).astype({"bucket": "Int32", "good": "Int64", "bad": "Int64"})
        used = np.flatnonzero(counts.any(0))
        if len(used):
            yield pd.DataFrame({"kind": 0, "bucket": used, "good": counts[1][used], "bad": counts[0][used], "key": None, "label": None, "grams": None}).astype(
                {"key": "Int64", "label": "Int32"}
            )

    return run


def _fitter(good: np.ndarray, bad: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        r = log_count_ratio(good, bad)
        made = fit([np.asarray(x) for x in rows["grams"]], np.where(rows["label"].to_numpy() > 0, 1, -1), r)
        out = io.BytesIO()
        np.savez(out, r=made.r, w=made.w, curve=np.array(made.curve))
        return pd.DataFrame({"model": [out.getvalue()]})

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Learns from the rows of ``labels`` (null labels and labels without a document teach nothing).

    All labelled documents count for the ratios; those whose hashed id falls under a share that leaves about
    ``max_fit_rows`` are gathered in one task to fit on. The driver sees sums by bucket and the model. Without
    any labels the model gives 0.5. A document with several labels is learned with each.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.when(F.col(label_col) > 0, 1).otherwise(0).alias("_label"))
    share = min(1.0, max_fit_rows / max(known.count(), 1))
    key = F.xxhash64(F.lit(9), F.col("_id"))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(known.hint("merge"), "_id")  # labels grow with the documents, so they are not broadcast
        .select("_text", "_label", key.alias("_key"), (F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000)).alias("_sampled"))
    )
    stats = Scratch(spark, "quality").table(rows.mapInPandas(_gather("_text", "_label"), _STATS), "stats")
    sums = stats.filter("kind = 0").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # 2 ** BITS rows at most
    good, bad, at = np.zeros(1 << BITS), np.zeros(1 << BITS), sums["bucket"].to_numpy()
    good[at], bad[at] = sums["good"].to_numpy(), sums["bad"].to_numpy()
    sample = stats.filter("kind = 1").select("key", "label", "grams", F.lit(0).alias("one"))
    made = sample.groupBy("one").applyInPandas(lambda pdf: _fitter(good, bad)(pdf), "model binary").first()
    if made is None:
        return fit([], np.zeros(0), log_count_ratio(good, bad))
    x = np.load(io.BytesIO(made.model))
    return Model(x["r"], x["w"], tuple(x["curve"]))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), plus score (0 to 1) and predicted (1 at the threshold and above).

    Null and empty texts get the score of no n-grams; a null id passes like any value; repeated rows are scored each;
    columns named score or predicted give way; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights and ratios: 2 MB

    def make():
        def run(texts: list[str | None]) -> dict:
            scores = sent.value.score(texts)
            return {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

        return run

    return map_text(docs, text_col, make, "score double, predicted int", keep_text=keep_text)


def _fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5))


def _trained(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs, labels.filter(_fold() != 0))


def op9_query(spark, sf_dir: str) -> DataFrame:
    """A null doc_id has no fold: its row is scored with a null ``held_out``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, _trained(spark, docs, sf_dir))
    return scored.select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text is judged by the score of no n-grams. Rows with a null id are scored, but teach nothing;
    repeated rows stay or go together. An empty table gives an empty one. Columns of any name pass through as they are.
    """
    plain, new = numbered(docs)
    scored = score(plain, _trained(spark, docs, sf_dir), text_col=new["text"], keep_text=True)
    return scored.filter("predicted = 1").select(*plain.columns).toDF(*docs.columns)
