"""Quality classifier: document evidence and hierarchical empirical Bayes over sites.

*Evidence.*  Two logistic models (low quality, toxic) over hashed words, word beginnings and binned style measures are
fitted on at most ``max_labelled`` labelled documents, those with the least hash of their id, and applied to every document by a map.

*Sites.*  The rates of each path (a part of a host) and host are Beta posteriors whose prior mean is the level above:
global, host, path.  The prior strength of a level is estimated from the spread of its groups' rates around the level above beyond what chance
gives, so sparse sites shrink to what is above them and large ones keep their own rate.  Everything about sites is
a grouped sum over all documents; a hot host is summed up before it is shuffled.

*Verdict.*  A document's odds are its evidence times the odds of its path, without its own share in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.tables import staged

#: Most labelled documents that the models are fitted on.
MAX_LABELLED = 5000
HASH_BITS = 17
#: Documents of the sample that a feature must occur in.
LEAST_DOCUMENTS = 4
#: Standard deviations from chance from which a feature takes part, and most features of a model.
LEAST_Z, MOST_FEATURES = 3.5, 4000
#: Bytes of word beginnings that are features, besides whole words.
PREFIXES = (4, 5, 6)
#: Bins of each style measure, at the quantiles of the sample.
BINS = 12
ROUNDS, PENALTY = 300, 0.05
HEADS = ("low", "toxic")
#: Posterior from which a document is rejected; a toxic document that stays does more harm than a clean one that goes.
LIMITS = {"low": 0.5, "toxic": 0.3}
STYLES = ("upper", "odd symbols", "exclamations", "digits", "distinct words", "repeats of the last word", "word length", "words")

_UPPER = W.separators((65, 90))
_LETTER = W.separators((65, 90), (97, 122), (128, 255))
_ODD = np.isin(np.arange(256), np.frombuffer(b"#$%&*|~^=<>{}[]\\_+", dtype=np.uint8))
_DIGIT = W.separators((48, 57))


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature) pairs, each once, and the style measures; ``used`` limits the features to those marked."""
    raw = W.split(texts, W.WHITE_SPACE)
    words = W.split(texts, W.NOT_ALPHANUMERIC, lower=True)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[raw.data])])
        return np.diff(sums[raw.bounds])

    n = np.maximum(raw.counts, 1)
    letters, size = np.maximum(share(_LETTER), 1), np.maximum(np.diff(raw.bounds), 1)
    again = np.concatenate([[0], np.cumsum(np.r_[False, raw.hashes[1:] == raw.hashes[:-1]])])
    lengths = np.concatenate([[0], np.cumsum(raw.ends - raw.starts)])
    distinct = np.array([len(np.unique(raw.hashes[a:b])) for a, b in zip(raw.first[:-1], raw.first[1:], strict=True)])
    style = np.c_[
        share(_UPPER) / letters, share(_ODD) / size, share(np.arange(256) == 33) / size, share(_DIGIT) / size,
        distinct / n, np.diff(again[raw.first]) / n, np.diff(lengths[raw.first]) / n, np.log1p(raw.counts),
    ]

    doc, pairs = words.doc_of_word(), []
    for hashes in (words.hashes, *(words.prefix_hashes(k) for k in PREFIXES)):
        place = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        on = slice(None) if used is None else used[place]
        pairs.append((doc[on] << HASH_BITS) + place[on])
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1), style


class Model:
    """Fitted weights; a plain bounded object that is broadcast."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, style_weights: np.ndarray, bias: np.ndarray, prior: np.ndarray):
        self.edges, self.weights, self.style_weights, self.bias, self.prior = edges, weights, style_weights, bias, prior
        self.used = weights.any(axis=1)

    def logits(self, row: np.ndarray, col: np.ndarray, style: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(row, weights=self.weights[col, h], minlength=len(style)) for h in range(len(self.bias))], axis=1) + self.bias
        for k in range(style.shape[1]):
            out += self.style_weights[k, np.searchsorted(self.edges[k], style[:, k], side="right")]
        return np.clip(out, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fit(row: np.ndarray, col: np.ndarray, style: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic regression for each column of labels.

    Of the hashed features those whose documents differ from chance by ``LEAST_Z`` standard deviations take part, the
    ``MOST_FEATURES`` that differ most at most, and all style bins.  Steps are accelerated and scaled by a bound of the curvature.
    """
    n, heads = labels.shape
    size = 1 << HASH_BITS
    prior = (labels.sum(axis=0) + 1) / (n + 2)
    edges = np.stack([np.quantile(style[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(style.shape[1])]) if n else np.zeros((len(STYLES), BINS - 1))
    weights, style_weights = np.zeros((size, heads)), np.zeros((len(STYLES), BINS, heads))
    bias = np.log(prior / (1 - prior))
    bins = np.stack([np.searchsorted(edges[k], style[:, k], side="right") + k * BINS for k in range(len(STYLES))], axis=1)
    count = np.bincount(col, minlength=size)
    for h in range(heads):
        y = labels[:, h].astype(float)
        if not n or y.min() == y.max():
            continue
        mean = y.mean()
        z = (np.bincount(col, weights=y[row], minlength=size) - count * mean) / np.sqrt(np.maximum(count, 1) * mean * (1 - mean))
        z[count < LEAST_DOCUMENTS] = 0
        names = np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES]
        names = np.sort(names[np.abs(z[names]) >= LEAST_Z])
        m = len(names)
        at = np.full(size, -1)
        at[names] = np.arange(m)
        on = at[col] >= 0
        r, c = np.concatenate([row[on], np.repeat(np.arange(n), len(STYLES))]), np.concatenate([at[col[on]], m + bins.ravel()])
        total = m + len(STYLES) * BINS
        active = np.bincount(r, minlength=n) + 1.0
        step = 1 / (0.25 * np.bincount(c, weights=active[r], minlength=total) + PENALTY)
        step_b = 1 / (0.25 * active.sum())
        w, v, b, vb = np.zeros(total), np.zeros(total), bias[h], bias[h]
        for k in range(ROUNDS):
            error = _sigmoid(np.clip(np.bincount(r, weights=v[c], minlength=n) + vb, -30, 30)) - y
            new = v - step * (np.bincount(c, weights=error[r], minlength=total) + PENALTY * v)
            new_b = vb - step_b * error.sum()
            v, vb = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
            w, b = new, new_b
        weights[names, h] = w[:m]
        style_weights[..., h] = w[m:].reshape(len(STYLES), BINS)
        bias[h] = b
    return Model(edges, weights, style_weights, bias, prior)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on the labelled documents with the least hash of their id, ``max_labelled`` at most.

    ``docs`` has id and text; ``labels`` has id, quality and toxic.  Labels with a null, and ids labelled in
    contradicting ways, are not used.
    """
    sure = (
        labels.where("id is not null and quality is not null and toxic is not null")
        .groupBy("id")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("quality", "toxic") for n, f in (("lo", F.min), ("hi", F.max))))
        .where("lo_quality = hi_quality and lo_toxic = hi_toxic")
        .select("id", F.col("lo_quality").alias("quality"), F.col("lo_toxic").alias("toxic"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    chosen = staged(sure.orderBy(*order).limit(max_labelled), "labelled")

    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                row, col, style = features(chunk.column(1))
                cuts = np.searchsorted(row, np.arange(len(chunk) + 1))
                own = [col[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(2), chunk.column(3), pa.array(own, pa.binary()), pa.array([x.tobytes() for x in style], pa.binary())],
                    names=["quality", "toxic", "own", "style"],
                )

    rows = docs.join(F.broadcast(chosen), "id").select("id", "text", "quality", "toxic")
    got = rows.mapInArrow(run, "quality int, toxic int, own binary, style binary").toArrow()
    own = [np.frombuffer(x, dtype=np.int32) for x in got.column("own").to_pylist()]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col = np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int64)
    style = np.array([np.frombuffer(x) for x in got.column("style").to_pylist()]).reshape(-1, len(STYLES))
    y = np.c_[1 - got.column("quality").to_numpy(), got.column("toxic").to_numpy()].astype(int).reshape(-1, 2)
    return fit(row, col, style, y)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(all columns of docs but text, n_words, low, toxic): probabilities under the sample's prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                at = chunk.schema.get_field_index("text")
                row, col, style = features(chunk.column(at), shared.value.used)
                p = _sigmoid(shared.value.logits(row, col, style))
                counts = np.rint(np.expm1(style[:, -1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(chunk.column(k) for k in range(chunk.num_columns) if k != at), pa.array(counts), pa.array(p[:, 0]), pa.array(p[:, 1])],
                    names=[*rest, "n_words", *HEADS],
                )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_words long", "low double", "toxic double"]))


def _limited(within: float, squares: float, chance: float, effective: float) -> float:
    """Prior strength from how far the rates of groups spread beyond chance."""
    spread = max((squares - chance) / max(effective, 1e-9), 1e-9)
    return float(min(max(within / spread - 1, 1.0), 1e6))


def _host_strength(hosts: DataFrame, mean: float, head: str) -> float:
    """Prior strength of hosts, by moments of their rates around the mean of all."""
    r = F.col(head) / F.col("n")
    x = hosts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (r - mean) ** 2).alias("s"), F.sum(F.col("n") ** 2).alias("n2"), F.count("*").alias("k")).first()
    if not x.k or x.k < 2 or x.n <= x.k:
        return 1.0
    within = mean * (1 - mean)
    return _limited(within, x.s, (x.k - 1) * within, x.n - x.n2 / x.n)


def _path_strength(paths: DataFrame, head: str) -> float:
    """Prior strength of paths, by moments of their rates around those of their hosts; differences between hosts play no part."""
    n, total = F.col("n"), F.sum(head)
    host = paths.groupBy("host").agg(
        F.sum(n).alias("n"), (total / F.sum(n)).alias("m"), F.count("*").alias("k"), (F.sum(F.col(head) ** 2 / n) - total**2 / F.sum(n)).alias("s"),
        (F.sum(n) - F.sum(n**2) / F.sum(n)).alias("effective"),
    )
    within = F.col("m") * (1 - F.col("m"))
    x = host.agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("effective").alias("effective"), F.sum((F.col("k") - 1) * within).alias("chance"),
        (F.sum(F.col("n") * within) / F.sum("n")).alias("within"), F.max("k").alias("most"),
    ).first()
    if not x.k or x.most < 2 or x.n <= x.k:
        return 1.0
    return _limited(x.within, x.s, x.chance, x.effective)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | str = "source",
    path: Column | str = "lang",
    *,
    max_labelled: int = MAX_LABELLED,
    model: Model | None = None,
) -> DataFrame:
    """One row per document: id, n_words, evidence and posterior of both heads, the site's rates, and ``keep``.

    ``host`` and ``path`` are columns of ``docs``; a null one is a site of its own.  ``labels`` has the id, ``quality`` (0 low)
    and ``toxic``.  A document is kept if neither posterior reaches its limit in ``LIMITS``; a document
    without words is not kept.  Without labels, or with one class only, the evidence is the prior.
    Repeated rows are judged each; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(host) if isinstance(host, str) else host).cast("string").alias("host"),
        (F.col(path) if isinstance(path, str) else path).cast("string").alias("path"),
    )
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    model = model or train(docs.select("id", "text"), labels, max_labelled)
    seen = staged(evidence(docs, model), "evidence")
    sums = [F.count("*").alias("n"), *(F.sum(h).alias(h) for h in HEADS)]
    paths = staged(seen.where("n_words > 0").groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in HEADS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in HEADS)).first()
    rates = {}
    for k, h in enumerate(HEADS):
        mean = (total[h] + float(model.prior[k])) / (total.n + 1) if total.n else float(model.prior[k])
        rates[h] = mean, _host_strength(hosts, mean, h), _path_strength(paths, h)
    site = hosts.select("host", *(((F.col(h) + rates[h][1] * rates[h][0]) / (F.col("n") + rates[h][1])).alias(f"host_{h}") for h in HEADS))
    site = (
        paths.withColumnsRenamed({"host": "h2", "n": "path_n", **{h: f"path_sum_{h}" for h in HEADS}})
        .join(site, F.col("h2").eqNullSafe(F.col("host")))
        .drop("host")
        .withColumnRenamed("path", "p2")
    )
    both = seen.join(site, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    out = {}
    for k, h in enumerate(HEADS):
        above = F.coalesce(F.col(f"host_{h}"), F.lit(rates[h][0]))
        # the path's posterior without the document itself
        others = (F.coalesce(F.col(f"path_sum_{h}"), F.col(h)) - F.col(h) + rates[h][2] * above) / (F.coalesce("path_n", F.lit(1)) - 1 + rates[h][2])
        out[f"site_{h}"] = others
        out[f"p_{h}"] = 1 / (1 + F.exp(-(_logit(F.col(h)) - float(np.log(model.prior[k] / (1 - model.prior[k]))) + _logit(others))))
    both = both.withColumns(out)
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        *(F.col(h).alias(f"evidence_{h}") for h in HEADS),
        *(F.col(f"host_{h}") for h in HEADS),
        *(F.col(f"site_{h}") for h in HEADS),
        *(F.col(f"p_{h}") for h in HEADS),
        ((F.col("n_words") > 0) & (F.col("p_low") < LIMITS["low"]) & (F.col("p_toxic") < LIMITS["toxic"])).alias("keep"),
    )
