"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of hashed features of its words (the
word, and its first four and five bytes); the document's is their noisy-or, ``1 - prod(1 - p)``.  Only documents are
labelled, so the sentences' scores are trained through the noisy-or, which also says which sentences offend.

Training reads a bounded sample of labelled rows, chosen by a hash of the id (``most_positive`` and ``most_negative``),
in one task.  Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import span_hashes
from .common import kept_names, mixed, row_blocks, text_bytes

BUCKETS = 1 << 18
BLOCK_BYTES = 1 << 20
PREFIXES = (4, 5)

_KIND = np.zeros(256, np.uint8)  # 0 between words, 1 in a word, 2 ends a sentence
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[128:] = 1
_KIND[[*b".!?\n"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its feature buckets (words x 3) and its sentence; per sentence its text, first and end byte.

    Words are runs of ASCII letters, digits and two-byte characters, of any length; characters of three or four bytes, whose
    scripts often have no spaces, are words of their own.  Sentences without words are left out; none crosses two texts.
    """
    n = len(data)
    kind = _KIND[data]
    word = kind == 1
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = word[first]
    opens |= data >= 0xE0
    closes = np.append(opens[1:] | ~word[1:], True) & word if n else word
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    breaks = np.cumsum(kind == 2)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    key = breaks[starts] + owner  # grows at each sentence end and each text
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    low = _LOWER[data]
    sizes = ends - starts
    hashed = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    if len(starts):
        hashed[:, 0] = mixed(span_hashes(low, starts, ends) + sizes.astype(np.uint64))
        for j, size in enumerate(PREFIXES):
            long = sizes >= size
            hashed[long, 1 + j] = mixed(span_hashes(low, starts[long], starts[long] + size) + np.uint64(1000 + size))
    buckets = (mixed(hashed) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    buckets[:, 1:][hashed[:, 1:] == 0] = 0  # shorter words have no such prefix
    return buckets, sentence, owner[head], starts[head], ends[np.append(head[1:], len(starts)) - 1] if len(head) else starts[head]


@dataclass
class Model:
    """``weights[0]`` is 0, for absent features."""

    weights: np.ndarray
    bias: float

    def sentences(self, buckets: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        logit = np.bincount(sentence, weights=self.weights[buckets].sum(axis=1), minlength=count) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def noisy_or(p: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """A text without sentences has probability 0."""
    return 1 - np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=texts))


def train(
    texts: list[str] | pa.Array, labels: np.ndarray, *, rounds: int = 200, rate: float = 0.1, decay: float = 0.05, at_least: int = 3, evidence: float = 3.0
) -> Model:
    """Adam on the noisy-or's cross-entropy.

    A feature is used if at least ``at_least`` texts have it and toxic ones have it more often than chance says, by
    ``evidence`` standard deviations; the others keep weight 0.  Equal texts count once, as toxic if one of them is.  With labels of one kind only,
    the model is a constant.
    """
    weights = np.zeros(BUCKETS, np.float64)
    once = pa.table({"text": pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "label": np.asarray(labels, np.float64)})
    once = once.group_by("text").aggregate([("label", "max")]).sort_by("text").combine_chunks()
    texts, labels = once.column("text").chunk(0) if len(once) else [], once.column("label_max").to_numpy()
    if len(texts) == 0 or labels.min() == labels.max():
        return Model(weights, 2.0 if len(texts) and labels[0] == 1 else -12.0)
    parts, having, toxic = [], np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    count = 0
    for lo, hi in text_blocks(texts):
        buckets, sentence, owner, _, _ = features(*text_bytes(texts[lo:hi]))
        pairs = np.unique(owner[sentence][:, None] * BUCKETS + buckets)
        having += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        toxic += np.bincount(pairs % BUCKETS, weights=labels[lo + pairs // BUCKETS], minlength=BUCKETS)
        parts.append((buckets, (sentence + count).astype(np.int32), (owner + lo).astype(np.int32)))
        count += len(owner)
    rate_toxic = labels.mean()
    above = (toxic - having * rate_toxic) / np.sqrt(np.maximum(having, 1) * rate_toxic * (1 - rate_toxic))
    usable = (having >= at_least) & (above >= evidence)
    usable[0] = False
    kept = np.flatnonzero(usable)
    number = np.zeros(BUCKETS, np.int32)
    number[kept] = np.arange(1, len(kept) + 1)
    columns, of, owner = [], [], np.concatenate([o for _, _, o in parts])
    for buckets, sentence, _ in parts:
        part = number[buckets]
        told = part.any(axis=1)  # words without a used feature say nothing
        columns.append(part[told]), of.append(sentence[told])
    columns, of = np.concatenate(columns), np.concatenate(of)
    del parts
    w, bias = np.zeros(len(kept) + 1), -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        logit = np.bincount(of, weights=w[columns].sum(axis=1), minlength=count) + bias
        p = np.minimum(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1 - 1e-9)
        all_clean = np.exp(np.bincount(owner, weights=np.log1p(-p), minlength=len(texts)))
        # d loss / d logit of a sentence: p for clean texts, -p * clean / (1 - clean) for toxic ones
        factor = np.where(labels == 1, -all_clean / np.maximum(1 - all_clean, 1e-9), 1.0)
        d = p * factor[owner]
        grad = np.zeros(len(w) + 1)
        for j in range(columns.shape[1]):
            grad[:-1] += np.bincount(columns[:, j], weights=d[of], minlength=len(w))
        grad[:-1] += decay * w
        grad[0], grad[-1] = 0, d.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    weights[kept] = w[1:]
    return Model(weights, float(bias))


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES):
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def is_held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, most_positive: int = 3000, most_negative: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most_positive`` and ``most_negative`` labelled texts that are not held out.

    Rows without an id or a label are left out; an id that has both labels counts as toxic.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(id_col))
        .groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
        .withColumn("_order", F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")))
    )
    chosen = []
    for toxic, most in ((1, most_positive), (0, most_negative)):
        chosen += known.where(F.col("_toxic") == toxic).orderBy("_order", id_col).limit(most).select(id_col, "_toxic").collect()
    if not chosen:
        return train([], np.zeros(0))
    wanted = docs.sparkSession.createDataFrame(chosen, known.select(id_col, "_toxic").schema)
    # The sample's ids: at most most_positive + most_negative rows.
    sample = docs.select(id_col, text_col).join(F.broadcast(wanted), id_col).select(F.coalesce(text_col, F.lit("")).alias("text"), "_toxic")
    return trained(sample)


def trained(sample: DataFrame) -> Model:
    """A model of the bounded ``sample`` (``text, _toxic``), trained in one task; the driver gets the weights that are not 0."""

    def run(batches):
        held = list(batches)
        texts = pa.chunked_array([b.column("text") for b in held], pa.string()).combine_chunks()
        model = train(texts, np.concatenate([np.zeros(0), *[np.asarray(b.column("_toxic")) for b in held]]))
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(model.weights[at], model.bias))], ["bucket", "weight"])

    rows = sample.select("text", F.col("_toxic").cast("int").alias("_toxic")).repartition(1).mapInArrow(run, "bucket int, weight double").collect()
    if not rows:
        return train([], np.zeros(0))
    weights = np.zeros(BUCKETS, np.float64)
    for bucket, weight in rows:
        if bucket >= 0:
            weights[bucket] = weight
    return Model(weights, next(weight for bucket, weight in rows if bucket < 0))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (``id_col`` alone by default), ``score`` and the sentence that says most: ``worst_start``, ``worst_end`` (bytes of the UTF-8
    text, null without words) and ``worst_score``.  A text without words scores 0; a null text counts as empty.  A kept column that has
    the name of another column gets ``in_`` in front of it."""
    keep = keep or [id_col]
    added = ["score", "worst_start", "worst_end", "worst_score"]
    names = kept_names(keep, {*added, "_text"})
    text = names[keep.index(text_col)] if text_col in keep else "_text"  # sent to the workers once
    sent = [F.col(c).alias(n) for c, n in zip(keep, names)] + ([] if text_col in keep else [F.col(text_col).alias(text)])
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for c, n in zip(keep, names))

    def run(batches):
        weights, bias = held.value
        own = Model(weights, bias)
        for batch in batches:
            for block in row_blocks(batch, text, BLOCK_BYTES):
                buckets, sentence, owner, starts, ends = features(*(x := text_bytes(block.column(text))))
                n, offsets = block.num_rows, x[1]
                p = own.sentences(buckets, sentence, len(owner))
                total = noisy_or(p, owner, n)
                order = np.lexsort((-np.arange(len(p)), p, owner))
                last = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(p) else order
                at = np.full(n, -1)
                at[owner[last]] = last
                none = at < 0
                pick = lambda a: pa.array(np.where(none, 0, a[at] if len(a) else 0), mask=none)
                base = offsets[:-1]
                columns = [block.column(c) for c in names] + [
                    pa.array(total), pick(starts - base[owner]).cast(pa.int64()), pick(ends - base[owner]).cast(pa.int64()), pick(p.astype(np.float64)).cast(pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.select(*sent).mapInArrow(run, f"{schema}, score double, worst_start long, worst_end long, worst_score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learnt from ``labels`` of ids that are not held out."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_start", "worst_end", "worst_score",
    )
