"""Scoring texts with a unigram lattice over an existing subword vocabulary, beside a smoothed word unigram.

The pieces of the vocabulary have the weights of their existing scores, and a word's probability by them is the
marginal over all its segmentations (forward recursion in log space; no piece crosses white space; a character
without a piece goes by its bytes). The lattice of a word has one more edge, over the whole word, weighted by the
word's count c among the N words of the training texts:

    P(word) = (1 - P(end)) * (SHARE * c / N + (1 - SHARE) * marginal over pieces)

SHARE is the one of SHARES that makes the training words likeliest when each leaves itself out, (c - 1) / (N - 1),
so it is learnt from all training texts; P(end) = (texts + 1) / (texts + N + 2). A text's score is the log10 of the
product over its words and its end.

Texts are coded once, in blocks: a block holds its different words and, for each text, the words' numbers. So what
is shuffled is each block's words, never each token. Counts return to the blocks by number: the words of most blocks
by a broadcast of at most FREQUENT of them, the others by a join, so no word is hot in it. A text's sums are made
where its block is.

Null and empty texts are just the end token. Held-out rows are scored but not counted. Null ids train or not by
the crc32 of an empty text. Rows that repeat an id are separate texts. Without training texts all counts are 0 and
SHARE is 0. An empty table gives an empty one. Bytes that are no UTF-8 count as U+FFFD in pieces. Only the two named
columns are read, so others may have any name."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._shared import in_arrow, mix64, slices_of, text_bytes, written

#: Bytes of text in a block, and coded at once; bytes of words weighed at once; words whose lattices are computed together; most pieces of a vocabulary.
BLOCK_BYTES, CODED_AT_ONCE, WEIGHED_AT_ONCE, TOGETHER, MOST_PIECES = 24_000_000, 1_000_000, 250_000, 8192, 1_000_000
#: Words broadcast at most, of 64 bytes at most each; shares of the whole-word edges to choose from.
FREQUENT, SHARES = 100_000, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999)
SPACE = "▁"


class Pieces(NamedTuple):
    """Texts and log weights of ordinary pieces, and log weights of the 256 single bytes."""

    texts: list[str]
    weights: np.ndarray
    byte_weights: np.ndarray


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a sentencepiece model. Scores that are whole numbers are ranks and count as 1 / (rank + 2); others are log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > MOST_PIECES:
        raise ValueError(f"{path} has over {MOST_PIECES} pieces")
    texts, scores, raw = [], [], np.full(256, -np.inf)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            raw[int(sp.id_to_piece(i)[3:5], 16)] = sp.get_score(i)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            texts.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
    s = np.array(scores, float)
    w = -np.log(2 - s + s.max()) if (s == np.round(s)).all() else s
    least = min(w.min(), raw[np.isfinite(raw)].min() if (raw[np.isfinite(raw)] < 0).any() else w.min())
    b = np.full(256, least)
    total = np.logaddexp(np.logaddexp.reduce(w), np.logaddexp.reduce(b))
    return Pieces(texts, w - total, b - total)


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(pieces.texts):
            if SPACE not in t[1:]:
                by_length.setdefault(len(t), []).append(i)
        self.tables = {}
        for length, own in by_length.items():
            codes = np.array([[ord(c) for c in pieces.texts[i]] for i in own], np.uint64)
            h = self.hashed(codes)
            order = np.argsort(h)
            self.tables[length] = h[order], np.array(own)[order]
        self.longest = max(self.tables, default=1)

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, j]
        return mix64(h)

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length of pieces, the weights at each start (-inf: no piece); bytes stand in for a character without a piece."""
        n = codes.shape[1]
        weights, rolled = [], np.zeros(codes.shape, np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            rolled = rolled[:, : n - length + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[:, length - 1 :]
            weight = np.full(rolled.shape, -np.inf)
            if length in self.tables:
                known, number = self.tables[length]
                h = mix64(rolled)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                weight = np.where(known[at] == h, self.pieces.weights[number[at]], -np.inf)
            weights.append(weight)
        bare = weights[0] == -np.inf
        if bare.any():
            chars, which = np.unique(codes[bare], return_inverse=True)
            by = np.array([sum(self.pieces.byte_weights[b] for b in chr(int(c)).encode(errors="replace")) for c in chars])
            weights[0][bare] = by[which]
        return weights

    def run(self, words: list[str]) -> np.ndarray:
        """The natural log of each word's marginal probability."""
        logs = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            step = max(1, min(TOGETHER, 200_000 // (length + 1)))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                flat = np.frombuffer("".join([SPACE + words[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
                logs[part] = self._one_length(flat.reshape(len(part), length + 1).astype(np.uint64))
        return logs

    def _one_length(self, codes: np.ndarray) -> np.ndarray:
        """Words of one length side by side: ahead[j] is the log probability of all ways to spell the first j characters."""
        m, n = codes.shape
        weights = self.edges(codes)
        ahead = np.full((n + 1, m), -np.inf)
        ahead[0] = 0
        w = [np.ascontiguousarray(x.T) for x in weights]
        for j in range(1, n + 1):
            ahead[j] = log_sum([ahead[j - k] + w[k - 1][j - k] for k in range(1, min(j, len(w)) + 1)])
        return ahead[n]


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    t = np.stack(terms)
    top = t.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(t - safe).sum(0)) + safe


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def coded(docs: DataFrame, held_out: Column, text: str, key: str) -> DataFrame:
    """One row a block: block, ids, held_out, sizes, codes (packed), words, counts (of training texts)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "ids", "held_out", "sizes", "codes", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, held, codes, size, id_type = Numbers(), [], [], [], 0, pa.int64()

        def block() -> pa.RecordBatch:
            train = [c for c, h in zip(codes, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(train) if train else np.empty(0, int), minlength=len(index))
            row = [uuid.uuid4().int >> 65, ids, held, [len(c) for c in codes], zlib.compress(np.concatenate(codes).astype("<i4").tobytes(), 1), list(index), counts]
            kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for part in slices_of(batch, 2, CODED_AT_ONCE):
                texts = text_bytes(part.column(2))
                if ids and size + sum(map(len, texts)) > BLOCK_BYTES:
                    yield block()
                    index, ids, held, codes, size = Numbers(), [], [], [], 0
                id_type = part.column(0).type
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                size += sum(map(len, texts))
                for x in texts:
                    found = x.lower().split()
                    codes.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
        if ids:
            yield block()

    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.transform(in_arrow, run, f"block bigint, ids array<{kind}>, held_out array<boolean>, sizes array<int>, codes binary, words array<binary>, counts array<bigint>")


@lru_cache(2)
def lattice(packed: bytes) -> Lattice:
    import pickle

    return Lattice(pickle.loads(packed))


def packed(pieces: Pieces) -> bytes:
    import pickle

    return pickle.dumps(pieces)


def weighed(lexicon: DataFrame, pieces: Pieces) -> DataFrame:
    """`lexicon` (word, c, n) with log, the natural log of each word's marginal probability over all segmentations."""
    sent = lexicon.sparkSession.sparkContext.broadcast(packed(pieces))  # bounded by MOST_PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, 0, WEIGHED_AT_ONCE):
                logs = lattice(sent.value).run([x.decode(errors="replace") for x in text_bytes(part.column(0))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logs, pa.float64())], names=["word", "c", "n", "log"])

    return lexicon.select("word", "c", "n").transform(in_arrow, run, "word binary, c bigint, n bigint, log double")


def best_share(known: DataFrame, n: int) -> float:
    """The one of SHARES under which the n training words of `known` (c, log) are likeliest, each left out of its own count."""
    if n < 2:
        return 0.0

    def likelihood(share: float) -> Column:
        counted = F.log(F.lit(share) * (F.col("c") - 1) / (n - 1))
        spelt = math.log(1 - share) + F.col("log")
        both = F.greatest(counted, spelt) + F.log1p(F.exp(-F.abs(counted - spelt)))
        return F.sum(F.col("c") * F.when(F.col("c") > 1, both).otherwise(spelt))

    found = known.where("c > 0").agg(*[likelihood(x).alias(f"s{i}") for i, x in enumerate(SHARES)]).first()
    return max(zip(found, SHARES, strict=True))[1]


def score(docs: DataFrame, held_out: Column, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = written(coded(docs, held_out, text, key))
    words = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    known = written(weighed(words.groupBy("word").agg(F.sum("count").alias("c"), F.count("*").alias("n")), read_pieces(model_path)))
    ends = blocks.select(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    n_words, v = known.select(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n_words + ends, v + (ends > 0)
    share = best_share(known, n_words)
    end = (ends + 1) / (n + 2)
    asked = blocks.select("block", F.posexplode("words").alias("at", "word"))
    short = known.where((F.col("n") > 1) & (F.octet_length("word") <= 64)).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "c", "log")
    asked = asked.join(F.broadcast(short), "word", "left")
    rare = asked.where("c is null").select("word", "block", "at").join(known.select("word", "c", "log"), "word")
    found = asked.where("c is not null").select("block", "at", "c", "log").unionByName(rare.select("block", "at", "c", "log"))
    of_block = found.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"), F.collect_list("log").alias("log"))
    joined = blocks.select("block", "ids", "held_out", "sizes", "codes").join(of_block, "block", "left")
    kind = docs.schema[key].dataType.simpleString()
    base_end = math.log10((ends + 1) / (n + 1 * (v + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, held = (row.column(i).flatten() for i in (1, 2))
                sizes = row.column(3).flatten().to_numpy()
                codes = np.frombuffer(zlib.decompress(row.column(4)[0].as_py()), "<i4")
                at, c, log = (row.column(i).flatten().to_numpy(zero_copy_only=False) for i in (5, 6, 7))
                count, weight = np.zeros(len(at), np.int64), np.zeros(len(at))
                count[at], weight[at] = c, log
                doc = np.repeat(np.arange(len(sizes)), sizes)

                def over(values: np.ndarray, doc=doc, codes=codes, m=len(sizes)) -> np.ndarray:
                    return np.bincount(doc, values[codes], m) if len(codes) else np.zeros(m)

                base = over(np.log10((count + 1) / (n + 1 * (v + 1)))) + base_end
                with np.errstate(divide="ignore"):
                    counted = np.log(count) + (math.log(share / n_words) if share else -np.inf)
                mine = (over(np.logaddexp(counted, weight + math.log(1 - share)) + math.log(1 - end)) + math.log(end)) / math.log(10)
                known_ = over((count > 0).astype(float)).astype(np.int64) + (ends > 0)
                columns = [ids, held, pa.array(sizes.astype(np.int64) + 1), pa.array(known_), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(mine)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.transform(in_arrow, total, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
