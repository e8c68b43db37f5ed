"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its first four letters, so inflected forms
share what their stem says. Filters of one, two and three words slide over the whole text; the largest response of each
filter over the text (max pooling) goes through a rectifier into one logit. Embeddings start from small noise and, in one
dimension, from the smoothed log-odds of documents with and without the label; all weights are then trained by Adagrad.

Thresholds are calibrated by language on labelled rows kept out of training. The language is guessed from a text's own
letters (never from a column); a language with few labelled toxic rows takes the threshold of all. The score is a
logistic function of the distance to the threshold, so 0.5 is the threshold of each language.

The weights are trained on at most ``SAMPLE_ROWS`` labelled rows of each label, those of the smallest hash of their id; this
is the only bound. The thresholds are chosen from all labelled rows kept out of training: labels are counted by language and
score (to six decimals), and running sums of that table, in cells of 1/1024, give the F1 of each possible limit. The model is about 2 MB; scoring is one pass without a shuffle, and a task remembers at most ``MAX_WORDS`` words.

Defined cases: a null or empty text is scored as a text without words. Labels with a null id or null label are left out; of
contradicting labels the larger counts. Without labels of both kinds every score is 0. Rows are independent; repeated rows
get equal scores. Columns of the input that have a result's name are replaced.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from formline.llm.common import add_struct, fresh, without
from formline.session import run_dir, staged

SAMPLE_ROWS = 3_000
BITS = 15  # of a hash; a word and a stem are packed into one int
DIM, FILTERS, WIDTHS = 8, 4, (1, 2, 3)
STEM = 4
PAD = 2 << BITS  # the row of zeros behind each text
MAX_WORDS = 400_000
WORD = re.compile(r"\w+")
#: Letters that tell a language; texts with hardly any of them are called "en".
LETTERS = {"de": "äöüß", "es": "ñíóáú", "fr": "éèêçàâîùû"}
LANGUAGES = ["en", *LETTERS]
SHARE = 0.01  # of the letters


def word_code(word: str) -> int:
    h = xxhash.xxh3_64_intdigest
    mask = (1 << BITS) - 1
    return (h(word) & mask) << BITS | h("^" + word[:STEM]) & mask


def language(text: str) -> str:
    found = {k: sum(map(text.count, v)) for k, v in LETTERS.items()}
    best = max(found, key=lambda k: found[k])
    return best if found[best] > SHARE * len(text) else "en"


def codes_of(text: str | None) -> list[int]:
    return [word_code(w) for w in WORD.findall((text or "").lower())]


@dataclasses.dataclass
class Model:
    rows: np.ndarray  # (2^(BITS+1) + 1, DIM): words, stems, and the row of zeros
    filters: dict[int, np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS)
    shift: float
    scale: float = 1.0
    thresholds: dict[str, float] = dataclasses.field(default_factory=dict)

    def projections(self) -> np.ndarray:
        """Each row's response to every filter column: (rows, 6 * FILTERS)."""
        return np.concatenate([self.rows @ w for k in WIDTHS for w in self.filters[k]], axis=1).astype(np.float32)


def split_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word and of the stem; PAD for -1."""
    pad = codes < 0
    return (np.where(pad, PAD, codes >> BITS), np.where(pad, PAD, (codes & (1 << BITS) - 1) + (1 << BITS)))


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All codes with as many pads behind each text as the widest filter needs, and where texts begin."""
    behind = np.full(max(WIDTHS), -1, np.int64)
    sizes = np.array([len(t) + len(behind) for t in texts], np.int64)
    return np.concatenate([x for t in texts for x in (t, behind)]), np.cumsum(sizes) - sizes


def responses(projected: np.ndarray) -> np.ndarray:
    """Responses of all filters at each position from the projections of the words there."""
    n, out, at = len(projected), [], 0
    for k in WIDTHS:
        total = np.zeros((n, FILTERS), projected.dtype)
        for o in range(k):
            total[:n - o] += projected[o:, at:at + FILTERS]
            at += FILTERS
        out.append(total)
    return np.concatenate(out, axis=1)


def within(fn: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``fn`` over each text's windows: those that begin at a word or the first pad, so none reaches the next text."""
    ends = np.append(starts[1:], len(values)) - max(WIDTHS) + 1
    return fn.reduceat(values, np.stack([starts, ends], 1).reshape(-1), axis=0)[::2]


def pooled(projected: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return within(np.maximum, responses(projected), starts)


def log_odds(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of the documents a row occurs in."""
    count = np.zeros((2, PAD + 1))
    for t, y in zip(texts, toxic, strict=True):
        for rows in split_codes(t):
            count[int(y), np.unique(rows)] += 1
    n = np.array([(~toxic).sum(), toxic.sum()])
    rate = (count + 0.5) / (n[:, None] + 1)
    out = np.log(rate[1]) - np.log(rate[0])
    out[(count.sum(0) == 0)] = 0
    out[PAD] = 0
    return out


def train(texts: list[np.ndarray], toxic: np.ndarray, visits: int = 20_000, batch: int = 128, rate: float = 0.05, seed: int = 0) -> Model:
    """Four passes over the texts, or as many as ``visits`` texts take where these are few."""
    epochs = max(4, visits // len(texts))
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 0.05, (PAD + 1, DIM))
    rows[:, 0] = log_odds(texts, toxic) / 4
    rows[PAD] = 0
    filters = {k: rng.normal(0, 0.3, (k, DIM, FILTERS)) for k in WIDTHS}
    for k in WIDTHS:
        filters[k][:, 0, :] = rng.uniform(0.5, 1.5, (k, FILTERS)) / k
    width = len(WIDTHS) * FILTERS
    model = Model(rows, filters, np.full(width, -0.5), rng.uniform(0.2, 0.6, width), -1.0)
    seen = {"rows": np.full(PAD + 1, 1e-3), "bias": np.full(width, 1e-3), "out": np.full(width, 1e-3), "shift": 1e-3,
            **{k: np.full_like(filters[k], 1e-3) for k in WIDTHS}}

    def step(name, value, grad):
        seen[name] = seen[name] + grad * grad
        return value - rate * grad / np.sqrt(seen[name])

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            codes, starts = padded([texts[i] for i in pick])
            word, stem = split_codes(codes)
            x = model.rows[word] + model.rows[stem]
            table = np.concatenate([x @ w for k in WIDTHS for w in model.filters[k]], axis=1)
            reply = responses(table)
            top = within(np.maximum, reply, starts)
            doc = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(codes))))
            place = np.where(reply == top[doc], np.arange(len(codes))[:, None], len(codes))
            at = within(np.minimum, place, starts)  # the first position of each maximum
            z = top + model.bias
            hidden = np.maximum(z, 0)
            error = 1 / (1 + np.exp(-(hidden @ model.out + model.shift))) - toxic[pick]
            back = error[:, None] * model.out * (z > 0) / len(pick)
            grad_rows = np.zeros((PAD + 1, DIM))
            for j, k in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                grad = np.zeros_like(model.filters[k])
                for o in range(k):
                    here = np.minimum(at[:, own] + o, len(codes) - 1)
                    grad[o] = np.einsum("nfd,nf->df", x[here], back[:, own])
                    send = back[:, own, None] * model.filters[k][o].T
                    for which in (word, stem):
                        np.add.at(grad_rows, which[here], send)
                model.filters[k] = step(k, model.filters[k], grad)
            grad_rows[PAD] = 0
            touched = np.flatnonzero(np.abs(grad_rows).max(axis=1) > 0)
            size = (grad_rows[touched] ** 2).mean(axis=1)
            seen["rows"][touched] += size
            model.rows[touched] -= rate * grad_rows[touched] / np.sqrt(seen["rows"][touched])[:, None]
            model.bias = step("bias", model.bias, back.sum(axis=0))
            model.out = step("out", model.out, (hidden * error[:, None]).mean(axis=0))
            model.shift = float(step("shift", model.shift, error.mean()))
    return model


class Scorer:
    """Logits of texts; words are looked up once and remembered."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.projections()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cache = np.zeros((1 << 12, self.table.shape[1]), np.float32)  # row 0: a pad

    def row(self, word: str) -> int:
        at = len(self.known) + 1
        self.known[word] = at
        if at >= len(self.cache):
            self.cache = np.concatenate([self.cache, np.zeros_like(self.cache)])
        code = word_code(word)
        self.cache[at] = self.table[code >> BITS] + self.table[(code & (1 << BITS) - 1) + (1 << BITS)]
        return at

    def logits(self, texts: list[str]) -> np.ndarray:
        """Logits of texts, all of them at once."""
        if len(self.known) > MAX_WORDS:
            self.forget()
        get, rows, sizes = self.known.get, [], []
        for t in texts:
            words = WORD.findall(t.lower())
            rows += [get(w) or self.row(w) for w in words]
            rows += [0] * max(WIDTHS)
            sizes.append(len(words) + max(WIDTHS))
        starts = np.cumsum(sizes) - sizes
        top = pooled(self.cache[np.array(rows, np.int64)], starts)
        return np.maximum(top + self.model.bias, 0) @ self.model.out + self.model.shift

    def all_logits(self, texts: list[str | None], characters: int = 1_000_000) -> np.ndarray:
        """Logits of texts, about so many characters at once."""
        if not texts:
            return np.empty(0)
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= characters:
                out.append(self.logits(part))
                part, size = [], 0
        if part:
            out.append(self.logits(part))
        return np.concatenate(out)

    def scores(self, texts: list[str | None], characters: int = 1_000_000) -> np.ndarray:
        if not texts:
            return np.empty(0)
        limit = np.array([self.model.thresholds.get(language((t or "").lower()), self.model.thresholds.get("", 0.0)) for t in texts])
        z = np.clip(self.model.scale * (self.all_logits(texts, characters) - limit), -500, 500)
        return 1 / (1 + np.exp(-z))


def best_threshold(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap with the best F1."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(z[1:] < z[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 2)) / 2)


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def counted(docs: DataFrame, known: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """language (also "", for all), logit, toxic and n: labelled documents by language and score. No text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []
    fields = StructType([StructField("language", StringType()), StructField("logit", DoubleType())])

    def batch(values: list) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(shared.value))
        return pa.StructArray.from_arrays([
            pa.array([language((t or "").lower()) for t in values], pa.string()),
            pa.array(scorers[0].all_logits(values), pa.float64())], names=["language", "logit"])

    scored = add_struct(docs.select("doc_id", F.col(f"`{text}`").alias("text")), "text", "x", fields, batch)
    return scored.select("doc_id", "x.*").join(known, "doc_id").select(
        F.explode(F.array("language", F.lit(""))).alias("language"), F.round("logit", 6).alias("logit"), "toxic").groupBy(
        "language", "logit").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))


def best_thresholds(counts: DataFrame, least: int = 10) -> dict[str, float]:
    """``best_threshold`` of each language from its table of counts; languages with ``least`` rows of each label, and "" with
    any. Sums run over cells first and then within each cell, which holds at most about 1,000 scores."""
    each = counts.withColumn("cell", F.floor(F.col("logit") * 1024))
    cells = each.groupBy("language", "cell").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.max("logit").alias("top"))
    every, down = Window.partitionBy("language"), Window.partitionBy("language").orderBy(F.desc("cell"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "language", "cell", F.lead("top").over(down).alias("below"), F.sum("toxic").over(every).alias("all_toxic"),
        F.sum("n").over(every).alias("all_n"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("toxic", "n")])
    inner = Window.partitionBy("language", "cell").orderBy(F.desc("logit"))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    hits, picked = (F.col(f"{c}_above") + F.sum(c).over(upto) for c in ("toxic", "n"))
    rows = each.join(cells, ["language", "cell"]).select(
        "language", "logit", "all_toxic", "all_n", F.coalesce(F.lead("logit").over(inner), "below").alias("next"),
        (2 * hits / (picked + F.col("all_toxic"))).alias("f1"))
    best = rows.groupBy("language", "all_toxic", "all_n").agg(
        F.max_by(F.struct("logit", "next"), F.struct("f1", "logit")).alias("z")).collect()
    return {r.language: (r.z.logit + (r.z.logit - 2 if r.z.next is None else r.z.next)) / 2 for r in best
            if min(r.all_toxic, r.all_n - r.all_toxic) >= (least if r.language else 1)}


def calibrate(docs: DataFrame, known: DataFrame, model: Model, text: str = "text") -> dict[str, float]:
    """Thresholds from all labelled rows of remainder 4; where these lack a label, from all that may be read."""
    folder = run_dir(docs.sparkSession, "toxicity")
    found: dict[str, float] = {}
    for name, own in (("held", remainder() == 4), ("all", remainder() > 0)):
        if "" not in found:
            found = best_thresholds(staged(counted(docs.where(own), known.where(own), model, text), f"{folder}/{name}"))
    return found


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from labelled rows whose crc32(doc_id) mod 5 is 1 to 3 (training) or 4 (thresholds); None without both labels."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder() > 0).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).where(remainder() < 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.union(some)
    # at most twice ``rows`` pairs of numbers, so the hint has a bound
    texts = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    fields = StructType([StructField("codes", ArrayType(IntegerType(), False))])

    def batch(values: list) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([codes_of(t) for t in values], pa.list_(pa.int32()))], names=["codes"])

    found = add_struct(texts, "text", "x", fields, batch).select("doc_id", "toxic", "x.*").toArrow().sort_by([("doc_id", "ascending")])
    toxic = np.array(found.column("toxic").to_pylist(), np.int64) == 1
    if not toxic.any() or toxic.all():
        return None
    codes = found.column("codes").combine_chunks()
    values, ends = codes.values.to_numpy().astype(np.int64), codes.offsets.to_numpy()
    model = train([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], toxic)
    model.thresholds = calibrate(docs, known.where("toxic in (0, 1)"), model, text)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    name = fresh("judged", docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def batch(values: list) -> pa.Array:
        if not scorers and shared.value is not None:
            scorers.append(Scorer(shared.value))
        out = scorers[0].scores(values) if scorers else np.zeros(len(values))
        return pa.StructArray.from_arrays([pa.array(out, pa.float64())], names=["score"])

    added = add_struct(docs, text, name, StructType([StructField("score", DoubleType())]), batch)
    value = F.col(f"`{name}`.score")
    rest = [f"`{c}`" for c in without(docs, ["score", "predicted"]).columns]
    return added.select(*rest, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    held = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")
