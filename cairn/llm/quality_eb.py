"""Quality and toxicity by hierarchical empirical Bayes.

A logistic classifier over hashed words gives each document its evidence. Per
host, and per path within a host, grouped sums of those probabilities make
beta posteriors: a path shrinks to its host, a host to the corpus, the more the
fewer documents it has. Prior strengths are fitted by moments from the spread
between sites. A document's posterior log-odds are its own evidence plus what
its path's posterior adds to the corpus's.

A source is a URL or a name: its host is what stands before the first slash, its
path the first part after it. A source without a path falls back to the language,
so documents of one language on a host form a site.

The classifier is fitted on at most ``TRAIN`` labelled documents, those with the
smallest hashed ids; a fifth of them set its scale. All other statistics cover
every document.

Defined results: a null or empty text has the evidence of no words, texts are read
whole, however long; a null source is a host of its own; of rows that share a
labelled id the smallest text is learned from; labels without a document, null labels and repeated
labels (the largest counts) do no harm; without labels of both kinds a score
is 0.5 for quality and 0 for toxicity, so nothing is rejected; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import checkpoint, fits, small_batches, text_of, worker_cache

TRAIN, BITS, ROUNDS, RIDGE = 6_000, 16, 100, 1e-4
SHAPES = ("symbols", "distinct", "length", "word_length", "digits", "upper", "marks")
WIDTH = (1 << BITS) + len(SHAPES)
TARGETS = ("quality", "toxic")
REMEMBERED = 400_000
#: What a word weighs against the shape features, which lie between 0 and 1.
WORD = 1.0
STEMS = (5, 7)
PRIOR = 20.0
#: Documents are toxic from this posterior on.
TOXIC = 0.2
UPPER = bytes(range(65, 91))


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = xxhash.xxh32_intdigest(word) & (1 << BITS) - 1
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: distinct words with equal weight, then the text's shape."""
    cased = text.encode("utf-8", "surrogatepass")
    data = cased.lower()
    words = data.split()
    buckets = worker_cache().setdefault("eb buckets", Buckets())
    distinct = set(data.translate(None, b".,;:!?()[]\"'").split())
    # Stems carry over to words that the labelled documents lack.
    distinct |= {w[:k] + b"~" for w in distinct for k in STEMS if len(w) >= k}
    places = np.fromiter(map(buckets.__getitem__, distinct), np.int32, len(distinct))
    n = max(1, len(words))
    shape = (
        min(1.0, (len(data) - len(data.translate(None, b"#*$%&|<>"))) / n),
        min(1.0, len(distinct) / n),
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, len(data) / n / 20),
        min(1.0, (len(data) - len(data.translate(None, b"0123456789"))) / n),
        (len(cased) - len(cased.translate(None, UPPER))) / max(1, len(cased)),
        min(1.0, (len(data) - len(data.translate(None, b"!?|{}[]"))) / n),
    )
    values = np.full(len(places), WORD)
    return np.r_[places, np.arange(1 << BITS, WIDTH, dtype=np.int32)], np.r_[values, shape]


def minimise(loss, w: np.ndarray, kept: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        d, used = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(used)):
            d = d + s * (a - (y @ d) / (s @ y))
        size = 1.0 if steps else min(1.0, 1 / max(1e-12, np.abs(g).sum()))
        while size > 1e-8:
            then, g_then = loss(w + size * d)
            if then <= value + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        s, y = size * d, g_then - g
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-kept:]
        done = value - then < 1e-7 * max(1.0, abs(value))
        w, value, g = w + s, then, g_then
        if done:
            break
    return w


def fit(rows: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, the last one the intercept, scaled on a held-out fifth."""
    n = len(y)
    held = np.arange(n) % 5 == 4
    if n < 10 or len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return np.zeros(WIDTH + 1)  # no evidence either way
    weight = np.where(held, 0.0, 1.0 / (~held).sum())
    mean = float(y[~held].mean())
    # A word enters by its log odds, shrunk to none over ``PRIOR`` documents; shapes enter as they are.
    seen = np.bincount(places, (~held)[rows], WIDTH)
    yes = np.bincount(places, ((~held) * y)[rows], WIDTH)
    odds = np.log((yes + PRIOR * mean) / (seen - yes + PRIOR * (1 - mean)) * (1 - mean) / mean)
    odds[1 << BITS :] = 1.0
    values = values * odds[places]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, values * w[places], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.r_[np.bincount(places, values * error[rows], WIDTH) + RIDGE * w[:-1], error.sum()]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * w[:-1] @ w[:-1]), g

    start = np.zeros(WIDTH + 1)
    start[-1] = np.log(mean / (1 - mean))
    w = minimise(loss, start)
    z = (np.bincount(rows, values * w[places], n) + w[-1])[held]
    scale, shift = 1.0, 0.0
    for _ in range(200):
        error = 1 / (1 + np.exp(-(scale * z + shift))) - y[held]
        scale -= 0.05 * (error * z).mean()
        shift -= 0.05 * error.mean()
    w = np.r_[w[:-1] * odds, w[-1]] * max(0.1, scale)
    w[-1] += shift
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> np.ndarray:
    """A row of weights for each target, from a bounded sample of labelled documents."""
    known = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(t).cast("double").alias(t) for t in TARGETS))
        .orderBy(F.xxhash64("doc_id"))
        .limit(most)
    )
    schema = "doc_id long, quality double, toxic double, places array<int>, vals array<double>"

    def run(batches):
        for b in batches:
            pairs = [features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), b.column("toxic"), pa.array([p for p, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float64()))],
                ["doc_id", "quality", "toxic", "places", "vals"],
            )

    # ``known`` has at most ``most`` rows of three numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    got = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", *TARGETS).agg(F.min("text").alias("text")).mapInArrow(run, schema)
    table = got.toArrow().sort_by("doc_id")
    out = np.zeros((len(TARGETS), WIDTH + 1))
    out[1, -1] = -20.0
    if not table.num_rows:
        return out
    column = table.column("places").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(table.num_rows), sizes)
    places = column.flatten().to_numpy()
    values = table.column("vals").combine_chunks().flatten().to_numpy()
    for k, target in enumerate(TARGETS):
        y = table.column(target).to_numpy(zero_copy_only=False).astype(float)
        ok = ~np.isnan(y)
        new = np.cumsum(ok) - 1
        some = ok[rows]
        fitted = fit(new[rows[some]], places[some], values[some], y[ok])
        if fitted.any():
            out[k] = fitted
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(sites: DataFrame, p: str, mean: float) -> float:
    """Documents that a prior is worth, by moments over the sites of two documents or more."""
    r = sites.filter("n > 1").agg(
        F.avg((F.col(p) / F.col("n") - mean) ** 2).alias("between"),
        F.avg((F.col(p + "2") / F.col("n") - (F.col(p) / F.col("n")) ** 2) / F.col("n")).alias("noise"),
    ).first()
    if r["between"] is None:
        return 10.0
    spread = max(1e-6, r["between"] - (r["noise"] or 0.0))
    return float(min(1e4, max(1.0, mean * (1 - mean) / spread - 1)))


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """One row per document: evidence, posteriors and the verdict ``kept``."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(train(docs, labels, most))

    def run(texts: pa.Array) -> pa.Array:
        w, out = weights.value, []
        for text in texts.to_pylist():
            places, values = features(text or "")
            out.append(w[:, places] @ values + w[:, -1])
        z = np.array(out).reshape(-1, len(TARGETS))
        return pa.StructArray.from_arrays([pa.array(z[:, k]) for k in range(len(TARGETS))], list(TARGETS))

    kind = T.StructType([T.StructField(t, T.DoubleType()) for t in TARGETS])
    source = F.lower(F.coalesce(F.col("source").cast("string"), F.lit("")))
    rest = F.regexp_replace(source, r"^[a-z][a-z0-9+.-]*://", "")
    path = F.regexp_extract(rest, r"^[^/?#]*/([^/?#]*)", 1)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    scored = checkpoint(
        docs.select(
            F.col("doc_id"),
            F.regexp_extract(rest, r"^([^/?#]*)", 1).alias("host"),
            F.when(path != "", path).otherwise(lang).alias("path"),
            F.arrow_udf(run, kind)(text_of()).alias("z"),
        ).select("doc_id", "host", "path", *(F.col(f"z.{t}").alias(f"z_{t}") for t in TARGETS))
    )
    sums = [F.count("*").alias("n")]
    for t in TARGETS:
        p = _sigmoid(F.col(f"z_{t}"))
        sums += [F.sum(p).alias(f"p_{t}"), F.sum(p * p).alias(f"p_{t}2")]
    paths = checkpoint(scored.groupBy("host", "path").agg(*sums))
    total = [F.sum(c).alias(c) for c in paths.columns[2:]]
    # Kept before the joins, so that the join of a large host's paths can be split.
    hosts = checkpoint(paths.groupBy("host").agg(*total))
    whole = paths.agg(*total).first()
    mean = {t: whole[f"p_{t}"] / whole["n"] if whole["n"] else 0.5 for t in TARGETS}
    strong = {t: (_strength(hosts, f"p_{t}", mean[t]), _strength(paths, f"p_{t}", mean[t])) for t in TARGETS}

    def shrunk(prior: Column, strength: float, t: str) -> Column:
        return (strength * prior + F.col(f"p_{t}")) / (strength + F.col("n"))

    hosts = hosts.select("host", *(shrunk(F.lit(mean[t]), strong[t][0], t).alias(f"host_{t}") for t in TARGETS))
    sites = paths.join(hosts, "host").select(
        "host", "path", *(f"host_{t}" for t in TARGETS),
        *(shrunk(F.col(f"host_{t}"), strong[t][1], t).alias(f"path_{t}") for t in TARGETS),
    )
    sites = checkpoint(sites)
    if fits(sites, "host", "path"):
        sites = F.broadcast(sites)
    post = {t: _sigmoid(F.col(f"z_{t}") + _logit(F.col(f"path_{t}")) - _logit(F.lit(mean[t]))) for t in TARGETS}
    joined = scored.join(sites, ["host", "path"]).withColumns({f"{t}_probability": post[t] for t in TARGETS})
    kept = (F.col("quality_probability") >= 0.5) & (F.col("toxic_probability") < TOXIC)
    return joined.select(
        "doc_id", "host", "path",
        *(_sigmoid(F.col(f"z_{t}")).alias(f"{t}_evidence") for t in TARGETS),
        *(F.col(f"{a}_{t}").alias(f"{t}_{a}") for t in TARGETS for a in ("host", "path")),
        *(f"{t}_probability" for t in TARGETS),
        (F.col("toxic_probability") >= TOXIC).alias("is_toxic"),
        kept.alias("kept"),
    )
