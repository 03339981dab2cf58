"""10. Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 letters of
the lower-cased text, every run of other characters being one space). The
model is trained with FTRL-proximal (per-coordinate follow-the-regularised-
leader) under an elastic net, whose L1 part leaves most weights at zero;
a part of the sample that training never saw sets one softmax temperature.

The sample is bounded: about ``per_language`` documents of each language,
drawn by a hash of the id, are turned into sparse features where they lie and
trained on in one task. Everything else covers all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
with no labelled row to learn from, every row is; a null ``doc_id`` counts as
an empty one when rows are split; null languages teach nothing; very long
texts are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

DIM = 1 << 15
#: Documents of the sample: of one language, and in all, however many languages there are.
PER_LANGUAGE, IN_ALL = 1500, 60_000
ALPHA, BETA, L1, L2, EPOCHS = 0.8, 1.0, 0.02, 0.02, 3
OTHER = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their damped counts."""
    letters = " " + OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(letters.encode("utf-32-le", "replace"), np.uint32)
    h = [c * np.uint32(0x9E3779B1)]
    for _ in range(2):
        prev = h[-1][:-1]
        h.append((prev ^ (prev >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[len(h):] * np.uint32(0xC2B2AE3D))
    mixed = np.concatenate(h)
    at = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    counts = np.bincount(at, minlength=DIM)
    idx = np.flatnonzero(counts)
    return idx, np.log1p(counts[idx])


def _weighted(idx, tf, idf) -> np.ndarray:
    v = tf * idf[idx]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(labels: list[str], docs: list[tuple[np.ndarray, np.ndarray]], seed: int = 10, epochs: int = EPOCHS) -> dict:
    """The model of documents given as (feature numbers, damped counts), in the given order."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    df = np.zeros(DIM)
    for idx, _ in docs:
        df[idx] += 1
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    held = np.arange(len(docs)) % 5 == 4 if len(docs) >= 50 else np.zeros(len(docs), bool)
    z, n = np.zeros((DIM, len(names))), np.zeros((DIM, len(names)))
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            idx, v = docs[i][0], _weighted(*docs[i], idf)
            zi, ni = z[idx], n[idx]
            w, wb = weights(zi, ni), weights(zb, nb)
            err = _softmax(v @ w + wb)
            err[y[i]] -= 1
            g = v[:, None] * err
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[idx] = ni + g * g
            zb += err - (np.sqrt(nb + err * err) - np.sqrt(nb)) / ALPHA * wb
            nb += err * err
    w, wb = weights(z, n), weights(zb, nb)
    temperature = 1.0
    if held.any():
        logits = np.array([_weighted(*docs[i], idf) @ w[docs[i][0]] + wb for i in np.flatnonzero(held)])

        def loss(t):
            p = _softmax(logits / t)[np.arange(len(logits)), y[held]]
            return -np.log(np.maximum(p, 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return {"names": names, "idf": idf.astype(np.float32), "w": w.astype(np.float32),
            "b": wb.astype(np.float32), "t": temperature}


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    if model is None or not text or not LETTER.search(text):
        return "und", 0.0
    idx, tf = grams(text)
    p = _softmax((_weighted(idx, tf, model["idf"]) @ model["w"][idx] + model["b"]) / model["t"])
    best = int(p.argmax())
    return model["names"][best], float(p[best])


def _features(batches):
    for b in batches:
        feats = [grams(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([i.astype(np.int32) for i, _ in feats], pa.list_(pa.int32())),
             pa.array([t.astype(np.float32) for _, t in feats], pa.list_(pa.float32()))],
            names=["draw", "lang", "idx", "tf"])


def _fit_group(rows: pa.Table) -> pa.Table:
    order = pc.sort_indices(rows, sort_keys=[("draw", "ascending"), ("lang", "ascending")]).to_pylist()
    lang, idx, tf = rows["lang"].to_pylist(), list(rows["idx"]), list(rows["tf"])      # views of the one copy of the sample
    model = fit([lang[i] for i in order], [(idx[i].values.to_numpy(), tf[i].values.to_numpy()) for i in order])
    return pa.table([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """The model of ``labelled(doc_id, text, lang)``; only its weights reach the driver (under 1 MB a language)."""
    usable = lean(labelled).filter("lang is not null and text is not null")
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", F.octet_length("text")), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(1, IN_ALL // len(counts)))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("draw") < int(min(1.0, per_language / n) * (1 << 30))))
    sample = (usable.filter(F.col("text").rlike(r"\p{L}")).select(draw.alias("draw"), "lang", "text").filter(keep)
              .mapInArrow(_features, "draw long, lang string, idx array<int>, tf array<float>"))
    rows = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit_group, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else None


def _predicted(batches, model):
    for b in batches:
        out = [predict(model, t.as_py()) for t in b.column(2)]
        lang, score = zip(*out) if out else ([], [])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``.

    Rows whose ``crc32(doc_id) mod 3`` is 1 teach nothing.
    """
    model = train(docs.filter(~held_out()), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # DIM x languages floats
    return (lean(docs).select("doc_id", held_out().alias("held_out"), "text")
            .mapInArrow(lambda bs: _predicted(bs, shared.value), SCHEMA))


def reject_unknown(docs: DataFrame, min_score: float = 0.3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less sure than ``min_score``.

    With no label to learn from nothing can be told about a language: then only
    rows without a letter (or with a null text) go, and all others stay.
    """
    model = train(docs.filter(~held_out()), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def kept(batches):
        for b in batches:
            ok = []
            for t in b.column(at):
                text = t.as_py()
                if shared.value is None:
                    ok.append(bool(text and LETTER.search(text)))
                    continue
                lang, score = predict(shared.value, text)
                ok.append(lang != "und" and score >= min_score)
            yield b.filter(pa.array(ok, pa.bool_()))
    return lean(docs).mapInArrow(kept, docs.schema)
