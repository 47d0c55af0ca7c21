"""Scores of texts by an n-gram model that is learnt from the corpus itself: a weighted backoff automaton.

Contexts of up to ``order - 1`` words are states.  An arc for each n-gram that was counted leads to the state of its longest
suffix and weighs its log probability; a failure arc leads to the context without its first word and weighs the log of the
mass that is left for it.  One traversal from left to right carries the state of each text and adds up weights.

The model is as large as the corpus, so no task holds it.  Texts are kept in blocks of bounded size.  Blocks ask for the counts of
their own distinct words and n-grams: questions are packed by buckets of a hash, each bucket adds up what all blocks have
counted and answers each, and a block's automaton is built from its answers.  Words are told apart by their bytes and get
numbers; n-grams are tuples of such numbers, so nothing rests on a hash.  Where all training tokens of a word lie in one
block, the block knows the counts of its n-grams and doesn't ask.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import span_hashes
from .common import mixed, row_blocks, shared_folder, text_bytes

BLOCK_BYTES = 4 << 20
#: Tokens of the corpus to a bucket of questions.
BUCKET_TOKENS = 500_000
#: Tokens that one lane of the traversal goes through; longer texts are cut into lanes that overlap by a context.
LANE = 128

#: Numbers of words: 0 unknown, 1 the start of a text, others from 2.
START = 1


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes each as the largest needs, all first bytes first."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return b""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(data, np.uint8).reshape(-1, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def text_blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """``block, ids, train, sizes, tokens, n, words``: texts in blocks, each as numbers of the block's own words and the end (the
    empty word, number 0)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in row_blocks(batch, "text", BLOCK_BYTES):
                lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(piece.column("text"), "")))
                found, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists))
                real = np.asarray(pc.binary_length(found)) > 0  # what stands before leading white space is no word
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
                coded = found.filter(pa.array(real)).dictionary_encode()
                words = pa.concat_arrays([pa.array([b""]), coded.dictionary.cast(pa.binary())])
                tokens = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
                inside = np.ones(len(tokens), bool)
                inside[np.cumsum(sizes + 1) - 1] = False
                tokens[inside] = np.asarray(coded.indices) + 1
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), one(piece.column("id")), one(piece.column("train")), one(pa.array(sizes + 1, pa.int32())), pa.array([packed(tokens)], pa.binary()), pa.array([len(tokens)]), one(words)],
                    ["block", "ids", "train", "sizes", "tokens", "n", "words"],
                )
                number += 1

    given = docs.select(F.col(id_col).alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, sizes array<int>, tokens binary, n long, words array<binary>")


def trained(row: dict, tokens: np.ndarray, words: int) -> np.ndarray:
    """How often each of a block's words stands in its training texts."""
    return np.bincount(tokens[np.repeat(np.array(row["train"], bool), row["sizes"])], minlength=words)


# ---- words ------------------------------------------------------------------------------------------


def dealt(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the words by buckets of a hash of their bytes, where each bucket that has any begins in it (and the end), and the bucket."""
    data, offsets = text_bytes(words.cast(pa.string()))
    place = mixed(span_hashes(data, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64)) % np.uint64(buckets)
    order = np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")
    place = place[order].astype(np.int64)
    cuts = np.flatnonzero(np.append(True, np.diff(place) > 0))
    return order, np.append(cuts, len(order)), place[cuts]


def asked_words(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["block", "train", "sizes", "tokens", "n"]).to_pylist()):
                words = batch.column("words")[i].values
                counts = trained(row, unpacked(row["tokens"], row["n"]), len(words))
                order, cuts, places = dealt(words, buckets)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(order)))
                counts = counts[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int32()), pa.array([row["block"]] * len(places)), lists, pa.array([packed(counts[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary())],
                    ["bucket", "block", "words", "counts"],
                )

    return blocks.select("block", "train", "sizes", "tokens", "n", "words").mapInArrow(run, "bucket int, block long, words array<binary>, counts binary")


def answered_words(asked: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, numbers, counts, known``: the words' numbers and training counts in the order of the question; ``known``
    holds, once a bucket, how many words have a count."""

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group.column("block"))).combine_chunks()  # so that a repeated task gives the same numbers
        lists = group.column("words").combine_chunks()
        ends = np.cumsum(np.asarray(pc.list_value_length(lists))).tolist()
        starts = [0, *ends[:-1]]
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        asked_ = np.concatenate([unpacked(c, b - a) for c, a, b in zip(group.column("counts").to_pylist(), starts, ends)])
        total = np.bincount(codes, weights=asked_, minlength=len(coded.dictionary)).astype(np.int64)
        bucket = group.column("bucket")[0].as_py()
        number = np.where(total > 0, np.arange(len(total)) * buckets + bucket + 2, 0)[codes]
        total_ = total[codes]
        known = [int((total > 0).sum())] + [0] * (len(ends) - 1)
        parts = lambda v: pa.array([packed(v[a:b]) for a, b in zip(starts, ends)], pa.binary())
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "numbers": parts(number), "counts": parts(total_), "known": pa.array(known, pa.int64())})

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, numbers binary, counts binary, known long")


def with_numbers(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Blocks with ``numbers`` and ``counts`` of their words in place of the words, which from here on stand in the order of their numbers."""
    kind = dict(blocks.dtypes)["ids"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["tokens", "n"]).to_pylist()[0]
        told = {r["bucket"]: r for r in right.to_pylist()}
        words = left.column("words").combine_chunks().flatten()
        order, cuts, places = dealt(words, buckets)
        numbers, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for place, a, b in zip(places.tolist(), cuts.tolist(), cuts[1:].tolist()):
            numbers[order[a:b]], counts[order[a:b]] = unpacked(told[place]["numbers"], b - a), unpacked(told[place]["counts"], b - a)
        rank = np.argsort(numbers, kind="stable")
        to = np.empty_like(rank)
        to[rank] = np.arange(len(rank))
        kept = left.select(["block", "ids", "train", "sizes", "n"])
        new = {"tokens": to[unpacked(row["tokens"], row["n"])], "numbers": numbers[rank], "counts": counts[rank]}
        for name, values in new.items():
            kept = kept.append_column(name, pa.array([packed(values)], pa.binary()))
        return kept.append_column("w", pa.array([len(numbers)]))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"block long, ids {kind}, train array<boolean>, sizes array<int>, n long, tokens binary, numbers binary, counts binary, w long")


# ---- n-grams ----------------------------------------------------------------------------------------


class Block:
    """A block's tokens and its distinct n-grams, which are the same each time it is read."""

    def __init__(self, row: dict, order: int, texts_trained: int):
        w = row["w"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.tokens = unpacked(row["tokens"], row["n"])
        self.numbers = np.append(unpacked(row["numbers"], w), START)  # the start of a text stands last
        self.counts = np.append(unpacked(row["counts"], w), texts_trained)
        learnt = np.repeat(np.array(row["train"], bool), self.sizes)
        own = np.append(trained(row, self.tokens, w), int(np.sum(row["train"])))
        known, shared = self.counts > 0, self.counts > own
        words = w + 1
        #: For each order from 2: each token's n-gram (-1: none), and of each n-gram its shorter prefix, last word, local count and whether others may have it.
        self.grams = []
        before, of_prefix = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens, shared
        before[self.first] = w
        usable = known[self.tokens] & known[before]
        tuples = np.arange(words)[:, None]
        for _ in range(2, order + 1):
            at = np.flatnonzero(usable)
            key = before[at] * words + self.tokens[at]
            distinct, inverse = np.unique(key, return_inverse=True)
            gram = np.full(len(self.tokens), -1)
            gram[at] = inverse
            prefix, word = distinct // words, distinct % words
            tuples = np.concatenate([tuples[prefix], word[:, None]], axis=1)
            of_prefix = of_prefix[prefix] & shared[word]
            self.grams.append((gram, prefix, word, np.bincount(inverse[learnt[at]], minlength=len(distinct)), of_prefix, tuples))
            before = np.concatenate([[-1], gram[:-1]]) if len(gram) else gram
            before[self.first] = -1
            usable = (before >= 0) & known[self.tokens]

    def questions(self, buckets: int):
        """For each order: n-grams that others may have, as columns of words' numbers, and their bucket; by bucket and then by number."""
        for m, (_, _, _, count, shared, tuples) in enumerate(self.grams, 2):
            at = np.flatnonzero(shared)
            # In the order of words' numbers, but for the start, whose number is the least: its n-grams stand last.
            begin = int(np.searchsorted(tuples[at, 0], len(self.numbers) - 1))
            at = np.roll(at, len(at) - begin)
            columns = [self.numbers[tuples[at, j]] for j in range(m)]
            place = np.zeros(len(at), np.uint64)
            for c in columns:
                place = mixed(place * np.uint64(31) + c.astype(np.uint64))
            place = (place % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")
            yield m, at[order], [c[order] for c in columns], place[order], count[at[order]]


def asked_grams(blocks: DataFrame, order: int, buckets: int, texts_trained: int) -> DataFrame:
    """``bucket, block, size, n, columns, counts``: first words ascend, so their differences are packed."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for m, _, columns, place, counts in Block(row, order, texts_trained).questions(buckets):
                    cuts = np.append(np.flatnonzero(np.append(True, np.diff(place) > 0)), len(place)) if len(place) else np.zeros(1, np.int64)
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        steps = np.diff(columns[0][a:b], prepend=0)
                        out.append((int(place[a]), row["block"], m, b - a, [packed(steps), *(packed(c[a:b]) for c in columns[1:])], packed(counts[a:b])))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["bucket", "block", "size", "n", "columns", "counts"])

    return blocks.drop("ids").mapInArrow(run, "bucket int, block long, size int, n long, columns array<binary>, counts binary")


def answered_grams(asked: DataFrame) -> DataFrame:
    """``block, bucket, size, n, counts``: the training counts of all blocks together, in the order of the question."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = []
        for m in sorted({r["size"] for r in rows}):
            own = [r for r in rows if r["size"] == m]
            code, width = None, 1
            for j in range(m):
                column = np.concatenate([unpacked(r["columns"][j], r["n"]) if j else np.cumsum(unpacked(r["columns"][0], r["n"])) for r in own])
                values, at = np.unique(column, return_inverse=True)
                if code is not None:
                    _, at = np.unique(code * len(values) + at, return_inverse=True)
                code = at
            total = np.bincount(code, weights=np.concatenate([unpacked(r["counts"], r["n"]) for r in own])).astype(np.int64)[code]
            ends = np.cumsum([r["n"] for r in own])
            out += [(r["block"], r["bucket"], m, r["n"], packed(total[e - r["n"] : e])) for r, e in zip(own, ends.tolist())]
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(ANSWER, zip(*out))})

    ANSWER = [("block", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]
    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, size int, n long, counts binary")


# ---- the automaton ----------------------------------------------------------------------------------


class Automaton:
    """States of a block: 0 for no context, its words, the start, and its n-grams below the highest order.

    An n-gram hw of count c after a context h of count C has P(w|h) = (c + mu P(w|h')) / (C + mu), h' being h without its first
    word and mu the strength for contexts of that length; without context P(w) = (c + 1) / (N + V + 1).  These sum to one over
    the V words and one unknown word.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], strength: list[float], tokens_trained: int, vocabulary: int):
        words = len(block.numbers)
        order = len(counts) + 1
        known = block.counts > 0
        floor = tokens_trained + vocabulary + 1
        probability = (np.where(known[:-1], block.counts[:-1], 0) + 1) / floor
        # Arcs as state * words + word; the first state of each order's contexts.
        base = np.cumsum([0, 1, words, *[len(c) for c in counts[:-1]]])
        of_word = np.where(known, 1 + np.arange(words), 0) if order > 1 else np.zeros(words, np.int64)
        keys, weights, targets = [np.arange(words - 1)], [np.log10(probability)], [of_word[:-1]]
        states = 1 if order == 1 else int(base[order])
        self.fail, self.leave = np.zeros(states, np.int64), np.zeros(states)
        shorter, mass = probability, block.counts
        suffix_of = None  # of each n-gram, the n-gram without its first word
        for m, (gram, prefix, word, _, _, _) in enumerate(block.grams, 2):
            mu = strength[m - 2]
            state = base[m - 1] + prefix
            self.leave[base[m - 1] : base[m - 1] + len(mass)] = np.log10(mu / (mass + mu))
            if m > 2:
                self.fail[base[m - 1] : base[m - 1] + len(suffix_of)] = np.where(suffix_of >= 0, base[m - 2] + suffix_of, 0)
            at = np.flatnonzero(gram >= 0)
            suffix = np.full(len(prefix), -1)
            suffix[gram[at]] = block.tokens[at] if m == 2 else block.grams[m - 3][0][at]
            p = (counts[m - 2] + mu * shorter[suffix]) / (mass[prefix] + mu)
            seen = counts[m - 2] > 0
            target = (base[m] + np.arange(len(prefix)) if m < order else (base[m - 1] + suffix)) if order > 1 else 0
            keys.append((state * words + word)[seen]), weights.append(np.log10(p[seen])), targets.append(target[seen])
            shorter, mass, suffix_of = p, counts[m - 2], suffix
        # States grow from part to part, and each part is in order, so the whole is.
        self.keys, self.weights, self.targets = np.concatenate(keys), np.concatenate(weights), np.concatenate(targets)
        self.words, self.order = words, order
        self.start = int(of_word[-1])

    def traverse(self, tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of weights along each text.  Lanes go side by side, one token a step; a lane within a text first reads the
        ``order - 1`` tokens before it, which is all that a state depends on."""
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        begin = first[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(begin + LANE, (first + sizes)[owner])
        at = np.maximum(begin - (self.order - 1), first[owner])
        state = np.where(at == first[owner], self.start, 0)
        total = np.zeros(len(owner))
        alive = np.arange(len(owner))
        while len(alive):
            word = tokens[at[alive]]
            s, got = state[alive], np.zeros(len(alive))
            open_ = np.arange(len(alive))
            while len(open_):
                key = s[open_] * self.words + word[open_]
                near = np.argsort(key)  # neighbours in the table are looked up one after another
                open_, key = open_[near], key[near]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                done, rest = open_[hit], open_[~hit]
                got[done] += self.weights[found[hit]]
                s[done] = self.targets[found[hit]]
                got[rest] += self.leave[s[rest]]
                s[rest] = self.fail[s[rest]]
                open_ = rest
            state[alive] = s
            total[alive] += np.where(at[alive] >= begin[alive], got, 0)
            at[alive] += 1
            alive = alive[at[alive] < end[alive]]
        return np.bincount(owner, weights=total, minlength=len(sizes))


def scores(blocks: DataFrame, answers: DataFrame, order: int, buckets: int, strength: list[float], texts_trained: int, tokens_trained: int, vocabulary: int, id_col: str) -> DataFrame:
    kind = dict(blocks.dtypes)["ids"][len("array<") : -1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().flatten()
        row = left.drop_columns(["ids"]).to_pylist()[0]
        block = Block(row, order, texts_trained)
        told = {(r["size"], r["bucket"]): r for r in right.to_pylist()}
        counts = [g[3].copy() for g in block.grams]
        for m, at, _, place, _ in block.questions(buckets):
            if len(at):
                counts[m - 2][at] = np.concatenate([unpacked(r["counts"], r["n"]) for r in (told[m, int(p)] for p in np.unique(place))])
        base = np.log10((block.counts[:-1] + 1) / (tokens_trained + vocabulary + 1))
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = Automaton(block, counts, strength, tokens_trained, vocabulary).traverse(block.tokens, block.first, block.sizes)
        sum_ = lambda v: np.bincount(owner, weights=v[block.tokens], minlength=len(block.sizes))
        return pa.table({id_col: ids, "held_out": pa.array([not x for x in row["train"]]), "n_tokens": pa.array(block.sizes), "n_known": pa.array(sum_(block.counts[:-1] > 0).astype(np.int64)), "base_score": pa.array(sum_(base)), "score": pa.array(total)})

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def language_model_scores(docs: DataFrame, held_out: Column, *, order: int = 3, strength: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Words are runs without ASCII white space, A to Z in lower case, and each text has an end after them.  The model learns from the
    rows where ``held_out`` is not true.  ``base_score`` is the log10 probability by words alone (one added to each count), ``score`` by
    n-grams up to ``order``, smoothed with ``strength`` (one number for each length of a context from 1).  Null and empty texts are an
    end alone; repeated rows count and are scored apart; without training rows every token has probability 1 (N = V = 0).  A row's id may be null
    or stand in many rows.  No rows, no result.  Only the named columns are read.
    """
    strength = strength or [20.0, 5.0, 2.0, 1.0][: order - 1] + [1.0] * max(0, order - 5)
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def drop(*names: str) -> None:
        """Tables that nothing needs any more, and what was shuffled for others."""
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()

    texts = keep(text_blocks(docs, held_out, id_col, text_col), "texts")
    size = texts.agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("train", lambda x: x))).alias("texts"), F.sum(F.aggregate(F.arrays_zip("train", "sizes"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["train"], x["sizes"]).otherwise(0))).alias("tokens")).first()
    n, texts_trained, tokens_trained = (int(x or 0) for x in size)
    buckets = max(1, -(-n // BUCKET_TOKENS))
    words = keep(answered_words(asked_words(texts, buckets), buckets), "words")
    vocabulary = int(words.agg(F.sum("known")).first()[0] or 0)
    blocks = keep(with_numbers(texts, words, buckets), "blocks")
    drop("texts", "words")
    answers = keep(answered_grams(asked_grams(blocks, order, buckets, texts_trained)), "grams")
    drop()
    out = scores(blocks, answers, order, buckets, strength, texts_trained, tokens_trained, vocabulary, id_col)
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(tokens_trained).cast("long").alias("train_tokens"), "base_score", "score")


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of ``documents``; those whose id's CRC-32 leaves 2 when divided by 7 are held out."""
    from .common import table

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model_scores(table(spark, sf_dir, "documents"), held_out)
