"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document's posterior over the domains.
The documents' rates r >= ``least`` minimise the distance of the expected token totals,
sum of r * tokens * posterior, from the targets, by projected gradient steps.  The distance is
measured in the metric of the totals' Gram matrix, sum of tokens * posterior * posterior', in
which a step of length 1 is right as long as no rate is cut off at its bound.

A document's rate follows from its posterior and the list of steps so far, so no rate is
stored between steps: a step reads the stored posteriors, replays the steps before it, and
sends one vector of domain totals for each batch to be added up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvid.llm.quality import fitting
from corvid.llm.shared import giving_back, stored, work_dir

BITS = 12


class DomainModel:
    """Softmax regression on hashed byte trigrams."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    @staticmethod
    def features(texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 1 << BITS), "f4")
        for row, text in zip(out, texts, strict=True):
            step = 1 << 22
            for lo in range(0, len(text) - 2, step):
                x = np.frombuffer(text, np.uint8)[lo:lo + step + 2].astype(np.uint32)
                code = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
                row += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
        np.sqrt(out, out=out)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)

    def posterior(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], steps: int = 150, rate: float = 0.2) -> DomainModel:
        domains = sorted(set(labels))
        x = cls.features(texts)
        y = np.eye(len(domains), dtype="f4")[[domains.index(v) for v in labels]]
        w, b = np.zeros((x.shape[1], len(domains)), "f4"), np.log(y.mean(axis=0))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = x @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ ((z / z.sum(axis=1, keepdims=True) - y) / len(x)) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(domains, w.astype("f4"), b.astype("f4"))


def learn_domains(texts: DataFrame, labelled: DataFrame, sample_rows: int = 2000, sample_bytes: int = 16 << 20) -> DomainModel | None:
    """The classifier, learned in one task from a bounded sample of ``labelled`` (doc_id, domain): up
    to ``sample_rows`` rows by a hash of the id, with their whole texts out of ``texts`` (doc_id,
    text).  A row that no longer fits into ``sample_bytes`` is passed over; texts of more than a
    sixteenth of that come after the others, the shortest first.  The first row of each domain goes before all, so
    a domain that occurs is learned, or there is an error.  The sample is taken before the texts are
    looked up, so only ids and sizes are sent to where they lie.  Rows with a null id, domain or text
    are left out, and all but one of the domains of an id; None without any row."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    texts = texts.select("doc_id", "text").where("text is not null and doc_id is not null")
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    sized = known.join(sizes, "doc_id").withColumn("place", F.xxhash64("doc_id", F.lit("fit")))
    sized = stored(sized, f"{work_dir(texts.sparkSession, 'sample')}/sized")
    fit_in = F.col("size") <= sample_bytes // 16
    row = F.struct(*sized.columns)
    # the first of the short ones, or else the shortest
    order = F.struct(F.when(fit_in, 0).otherwise(F.col("size")), "place", "doc_id")
    heads = [r["r"] for r in sized.groupBy("domain").agg(F.min_by(row, order).alias("r")).collect()]
    some = sized.where(fit_in).orderBy("place", "doc_id").limit(sample_rows).collect()
    rest = sized.where(~fit_in).orderBy("size", "place", "doc_id").limit(sample_rows - len(some)).collect()
    picked = fitting(heads, some + rest, sample_bytes, "domain", "domain")
    if not picked:
        return None
    rows = texts.join(F.broadcast(texts.sparkSession.createDataFrame(picked, sized.schema).drop("size")), "doc_id")

    def fit(batches):
        import pickle

        import pyarrow as pa

        kept = {}
        for b in batches:
            for text, domain, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept[at] = max(kept.get(at, (b"", "")), (text.encode(), domain))  # an id counts once
        if not kept:
            return
        model = DomainModel.fit([kept[k][0] for k in sorted(kept)], [kept[k][1] for k in sorted(kept)])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((model.domains, model.weights, model.bias))], pa.binary())})

    import pickle

    row = rows.select("text", "domain", "place").repartition(1).mapInArrow(giving_back(fit), "model binary").first()
    return None if row is None else DomainModel(*pickle.loads(bytes(row[0])))


def _rates(posterior: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """The rates after some steps; all begin at 1 (or at ``least``)."""
    r = np.full(len(posterior), max(1.0, least))
    for u in steps:
        r = np.maximum(least, r - posterior @ u)
    return r


def _scored(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(doc_id, copy_key, n_tokens, posterior) for the rows (doc_id, text)."""
    state = docs.sparkSession.sparkContext.broadcast((model.domains, model.weights, model.bias))

    def run(batches):
        import pyarrow as pa

        own = DomainModel(*state.value)
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            p = np.concatenate([own.posterior(texts[lo:lo + 256]) for lo in range(0, len(texts), 256)] or [np.empty((0, len(own.domains)))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(own.domains), pa.int32()), pa.array(p.ravel().astype("f8")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(t.split()) for t in texts], pa.int64()), lists],
                                             ["doc_id", "copy_key", "n_tokens", "posterior"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy_key", F.xxhash64("doc_id", "text", F.lit("copies")))
    return rows.mapInArrow(giving_back(run), "doc_id long, copy_key long, n_tokens long, posterior array<double>")


class Mix:
    """Fitted mixture: the classifier and the steps that give every document its rate."""

    def __init__(self, model: DomainModel | None, steps: list[np.ndarray], least: float, totals: np.ndarray, targets: np.ndarray):
        self.model, self.steps, self.least, self.totals, self.targets = model, steps, least, totals, targets


def fit_mix(scored: DataFrame, model: DomainModel, weights: dict[str, float], budget: float | None = None, least: float = 0.0,
            most_steps: int = 40, close: float = 1e-6) -> Mix:
    """Steps until the expected totals are within ``close`` of the targets (as a part of the
    budget), no longer move, or ``most_steps`` are done.

    ``weights`` over the labelled domains are scaled to a sum of 1; a domain without a weight has
    0, one without labels is left out.  ``budget``: tokens of the mix; None: the tokens of the
    table, or with ``least`` > 0 the smallest budget whose targets no domain has to
    fall below ``least`` times its tokens for.
    """
    k = len(model.domains)
    p = [F.col("posterior")[i] for i in range(k)]
    n = F.col("n_tokens")
    sums = scored.agg(*[F.sum(n * p[i]) for i in range(k)], *[F.sum(n * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    flat = np.array([x or 0.0 for x in sums])
    have, gram = flat[:k], flat[k:].reshape(k, k)
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    if budget is None:
        budget = have.sum() if least <= 0 else least * max((h / s for h, s in zip(have, share, strict=True) if s > 0), default=have.sum())
    targets = share * budget
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(1.0, np.trace(gram)))

    steps: list[np.ndarray] = []
    totals, before = have * max(1.0, least), None
    while len(steps) < most_steps and np.abs(totals - targets).max() > close * max(1.0, budget):
        if before is not None and np.abs(totals - before).max() <= 0.01 * close * max(1.0, budget):
            break
        before = totals
        steps.append(inverse @ (totals - targets))

        def add(batches, steps=tuple(steps)):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    q = b.column(1).flatten().to_numpy().reshape(-1, k)
                    r = _rates(q, list(steps), least)
                    yield pa.RecordBatch.from_pydict({f"t{i}": pa.array([x]) for i, x in enumerate((q * (r * b.column(0).to_numpy())[:, None]).sum(axis=0))})

        parts = scored.select("n_tokens", "posterior").mapInArrow(giving_back(add), ", ".join(f"t{i} double" for i in range(k)))
        totals = np.array([x or 0.0 for x in parts.agg(*[F.sum(f"t{i}") for i in range(k)]).first()])
    return Mix(model, steps, least, totals, targets)


def _copies(rate, key):
    """A whole number of copies with the rate as its mean, the same in every run."""
    return (F.floor(rate) + (F.pmod(key, F.lit(1 << 20)) / (1 << 20) < rate - F.floor(rate)).cast("int")).cast("int")


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, least: float = 0.0,
                   texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, domain, membership, rate, copies) for every row of ``docs`` (doc_id, text).
    ``labelled`` (doc_id, domain) names domains of documents in ``texts`` (by default ``docs``).

    n_tokens: words without white space.  domain: the likeliest one (ties: the first name), with its
    posterior in membership.  copies: how often the row is taken.  A null text is empty: no tokens,
    the posterior of the labels' shares.  Without labelled rows domain and membership are null and
    all rates are 1.  Other columns are ignored."""
    model = learn_domains(docs if texts is None else texts, labelled)
    if model is None:
        return docs.select("doc_id", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "\\s+"), "")).cast("long").alias("n_tokens"),
                           F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("membership"),
                           F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    scored = stored(_scored(docs, model), f"{work_dir(docs.sparkSession, 'mix')}/scored")
    mix = fit_mix(scored, model, weights, budget, least)
    steps, domains = mix.steps, model.domains

    def rate(batches):
        import pyarrow as pa

        for b in batches:
            p = b.column(3).flatten().to_numpy().reshape(-1, len(domains))
            top = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([domains[i] for i in top], pa.string()),
                                              pa.array(p[np.arange(len(p)), top]), pa.array(_rates(p, steps, least))],
                                             ["doc_id", "copy_key", "n_tokens", "domain", "membership", "rate"])

    rated = scored.mapInArrow(giving_back(rate), "doc_id long, copy_key long, n_tokens long, domain string, membership double, rate double")
    return rated.select("doc_id", "n_tokens", "domain", "membership", "rate", _copies(F.col("rate"), F.col("copy_key")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, least: float = 1.0,
        texts: DataFrame | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says, all columns as they were.  With the default
    ``least`` of 1 the targets are reached by repeating, and no row is lost."""
    columns, schema = docs.columns, docs.schema
    model = learn_domains(docs if texts is None else texts, labelled)
    if model is None:
        return docs
    scored = stored(_scored(docs, model), f"{work_dir(docs.sparkSession, 'mix')}/scored")
    steps = fit_mix(scored, model, weights, budget, least).steps
    state = docs.sparkSession.sparkContext.broadcast((model.domains, model.weights, model.bias))
    count, text = "copies", columns.index("text")
    while count in columns:
        count += "_"

    def take(batches):
        import pyarrow as pa

        own = DomainModel(*state.value)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(text).to_pylist()]
            p = np.concatenate([own.posterior(texts[lo:lo + 256]) for lo in range(0, len(texts), 256)] or [np.empty((0, len(own.domains)))])
            r = _rates(p.astype("f8"), steps, least)
            key = b.column(b.num_columns - 1).to_numpy()
            n = np.floor(r) + (key % (1 << 20) / (1 << 20) < r - np.floor(r))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n.astype(np.int32))], [*columns, count])

    keyed = docs.withColumn(count, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit("copies")))
    out = keyed.mapInArrow(giving_back(take), StructType([*schema.fields, StructField(count, IntegerType())]))
    once = "copy_number"
    while once in columns or once == count:
        once += "_"
    return out.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(count))).alias(once)).select(*[F.col(f"`{c}`") for c in columns])
