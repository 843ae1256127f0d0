"""Token counts and ids as the ``tokenizers`` library gives them, through distinct pre-tokens.

For counts, the distinct pre-tokens of all documents are a table, and the
library counts the tokens of each of them once.  The frequencies of
pre-tokens in each document are joined to that table and summed.  The
FREQUENT most frequent pre-tokens, of which nearly all text consists, are
joined in the task that splits the text; only occurrences of the others are
rows of a shuffle, joined by the pre-token itself.

For ids, which packing needs in order, a worker keeps the pieces of the
pre-tokens it has met.  Strings of special tokens inside a text become that
token, as the library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, strings, written
from .pretokens import PieceCache, split_texts
from .textnum import U64, HashIndex, ragged

#: Distinct pre-tokens a worker holds; beyond it the cache starts anew.
CACHE_LIMIT = 700_000
#: Pre-tokens that are joined in the task; their number bounds what is sent to each worker.  Results never depend on it.
FREQUENT = 1 << 16
#: Longer pre-tokens are never among the frequent ones.
FREQUENT_CHARS = 64
#: Distinct pre-tokens a task holds before it hands their counts on.
HELD = 300_000
#: What the pre-tokenizer of the file must be, as texts are split by that rule.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class LibraryPieces:
    """Pieces of pre-tokens by the tokenizers library, for a byte-level BPE file."""

    def __init__(self, path: str, keep_ids: bool, limit: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        splitter = described.get("pre_tokenizer") or {}
        if described.get("normalizer") is not None or {k: splitter.get(k) for k in PRE_TOKENIZER} != PRE_TOKENIZER:
            raise ValueError(f"{path} does not split texts as byte-level BPE does")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        if len(special) > 1:
            raise ValueError("a vocabulary with one special token at most is expected")
        self.special, self.special_id = next(iter(special.items()), (None, -1))
        self.cache = PieceCache(self._encode, limit, keep_ids)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = [], np.zeros(len(words), np.int64)
        for k in range(0, len(words), 4096):
            got = self.tokenizer.encode(words[k : k + 4096], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            count += np.bincount(np.array(got.word_ids, np.int64) + k, minlength=len(words)) if got.ids else 0
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), count

    def chunks(self, texts: list[str]):
        """Yields (piece numbers, -1 for the special token; owner of each) by chunk."""
        for whole, h, s, e, owner in split_texts(texts, self.special):
            marked = s == e
            if marked.any():
                at = np.full(len(s), -1, np.int32)
                at[~marked] = self.cache.look_up(whole, h[~marked], s[~marked], e[~marked])
            else:
                at = self.cache.look_up(whole, h, s, e)
            yield at, owner

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts in order, and the offset of each text."""
        out, n = [], np.zeros(len(texts), np.int64)
        for at, owner in self.chunks(texts):
            marked = at < 0
            count = np.where(marked, 1, self.cache.count[at])
            ids = self.cache.ids[ragged(self.cache.begin[at] * ~marked, count)]
            if marked.any():
                ids[(np.cumsum(count) - count)[marked]] = self.special_id
            out.append(ids)
            n += np.bincount(owner, count, len(texts)).astype(np.int64)
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), off


@lru_cache(maxsize=2)
def library(path: str, keep_ids: bool, limit: int = CACHE_LIMIT) -> LibraryPieces:
    return LibraryPieces(path, keep_ids, limit)


def _distinct(texts: list[str], special: str | None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(pre-tokens, their hashes, how often they occur), once for each distinct one of a chunk."""
    for whole, h, s, e, _ in split_texts(texts, special):
        real = s != e
        u, at, n = np.unique(h[real], return_index=True, return_counts=True)
        s, e = s[real][at].tolist(), e[real][at].tolist()
        yield [whole[a:b] for a, b in zip(s, e)], u, n


def pre_token_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(piece, frequency, tokens): every distinct pre-token of all documents, its tokens counted once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = library(path, False).special
        held: dict[str, int] = {}
        for batch in batches:
            for words, _, n in _distinct(strings(batch, text_col), special):
                for w, k in zip(words, n.tolist()):
                    held[w] = held.get(w, 0) + k
                if len(held) > HELD:
                    yield from _pieces(held)
                    held = {}
        yield from _pieces(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(path, False)._encode
        for batch in batches:
            tokens = encode(strings(batch, "piece"))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], ["piece", "frequency", "tokens"])

    pieces = map_arrow(docs.select(text_col), split, "piece string, frequency long").groupBy("piece").agg(F.sum("frequency").alias("frequency"))
    return map_arrow(pieces, count, "piece string, frequency long, tokens long")


def _pieces(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
    words, n = list(held), list(held.values())
    for k in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.string()), pa.array(n[k : k + 50_000], pa.int64())], ["piece", "frequency"])


class _Frequent:
    """The most frequent pre-tokens by hash, with their tokens."""

    def __init__(self, words: list[str], tokens: list[int]):
        # a word is a text of one pre-token, so it has one hash
        h = np.concatenate([x[1] for x in split_texts(words)]) if words else np.zeros(0, U64)
        if len(h) != len(words):
            raise ValueError("a pre-token is split again")
        h, one = np.unique(h, return_index=True)
        self.index, self.tokens = HashIndex(18), np.array(tokens, np.int64)[one]
        self.size = np.fromiter(map(len, words), np.int64, len(words))[one]
        self.index.add(h, np.arange(len(h)))

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.index.find(h)
        return np.where((at >= 0) & (self.size[at] == size), at, -1) if len(self.size) else np.full(len(h), -1)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Tokens of every text, without materialising ids.

    Returns (id_col, n_bytes, n_tokens, over_limit: n_tokens > limit), one row
    per input row; repeated rows repeat, ids of any type and null ones are
    kept, a null text counts as empty (0, 0, false), other columns are not
    read.  An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    table = written(pre_token_table(docs, path, text_col), "pre-tokens")
    short = table.where(F.length("piece") <= FREQUENT_CHARS)
    # a row per power of 1.2: the least frequency that at most FREQUENT pre-tokens have
    step = F.floor(F.log(1.2, F.col("frequency")))
    least, held = float("inf"), 0
    for r in sorted(short.groupBy(step).agg(F.min("frequency"), F.count("*")).collect(), key=lambda r: -r[1]):
        held += r[2]
        if held > frequent:
            break
        least = r[1]
    top = short.where(F.col("frequency") >= least).select("piece", "tokens").collect()  # FREQUENT rows of FREQUENT_CHARS characters at most
    known = docs.sparkSession.sparkContext.broadcast(([r[0] for r in top], [r[1] for r in top]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, common = library(path, False).special, _Frequent(*known.value)
        for batch in batches:
            texts = strings(batch, text_col)
            total = np.zeros(len(texts), np.int64)
            rest: list[list[dict]] = [[] for _ in texts]
            for whole, h, s, e, owner in split_texts(texts, special):
                at = common.find(h, e - s)
                marked = s == e
                total += np.bincount(owner, np.where(marked, 1, np.where(at >= 0, common.tokens[at], 0) if len(common.tokens) else 0), len(texts)).astype(np.int64)
                rare = np.flatnonzero((at < 0) & ~marked)
                if len(rare):
                    rare = rare[np.lexsort((h[rare], owner[rare]))]
                    o, w = owner[rare], h[rare]
                    edge = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])))
                    first = rare[edge]
                    for k, a, b, n in zip(owner[first].tolist(), s[first].tolist(), e[first].tolist(), np.diff(np.append(edge, len(rare))).tolist()):
                        rest[k].append({"piece": whole[a:b], "n": n})
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total), pa.array(rest, pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())])))], [id_col, "n_bytes", "known", "rest"])

    row = free_name(docs.select(id_col), "row")
    split_docs = map_arrow(docs.select(id_col, text_col), split, f"`{id_col}` {id_type}, n_bytes long, known long, rest array<struct<piece: string, n: long>>")
    split_docs = written(split_docs.withColumn(row, F.monotonically_increasing_id()), "pre-token-frequencies")
    one = split_docs.where(F.size("rest") > 0).select(row, F.explode("rest").alias("of")).select(row, "of.piece", "of.n")
    counted = one.join(table.select("piece", "tokens"), "piece").groupBy(row).agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    total = (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return split_docs.drop("rest").join(counted, row, "left").select(id_col, "n_bytes", total).withColumn("over_limit", F.col("n_tokens") > limit)
