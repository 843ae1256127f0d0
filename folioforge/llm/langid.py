"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits.  A binary n-gram classifier per
bit (log-odds of hashed character 1- to 3-grams between the languages that
have the bit and those that have not) is learnt from labelled rows; a text is
decoded to the language whose codeword has the least loss, each bit's loss
weighted by how reliable that classifier was on the rows it was learnt from.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, strings, with_fields
from .textnum import LETTER, U64, char_classes, chunks, codepoints, splitmix

DIM_BITS = 13
DIM = 1 << DIM_BITS
UNDETERMINED = "und"
#: Rows per language, in expectation, from which classifiers are learnt.
SAMPLE_PER_LANGUAGE = 2000
#: n-grams that count as independent evidence at most: a longer text gives no higher score than its n-grams agree on.
EVIDENCE = 40.0
AMBIGUOUS_MARGIN = 0.2
#: Weight of a bit whose classifier does no better than guessing.
LEAST_RELIABLE = 0.05
_A, _B, _C = (U64(int(x)) for x in splitmix(np.arange(1, 4, dtype=U64)) | U64(1))


def ngram_counts(texts: list[str]) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams of each text: lower case, everything but letters as one blank."""
    for a, b in chunks(texts):
        low = [t.lower() for t in texts[a:b]]
        cp, off = codepoints(low)
        if not len(cp):
            yield from (np.zeros(DIM, np.int64) for _ in low)
            continue
        letter = char_classes()[cp] == LETTER
        c = np.where(letter, cp, 32).astype(U64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[off[off < len(cp)]] = True
        number = np.concatenate(([0], np.cumsum(keep)))
        c, off = c[keep], number[off]
        shift = U64(64 - DIM_BITS)
        one = ((c * _A) >> shift).astype(np.int64)
        two = ((c[:-1] * _A + c[1:] * _B) * _C >> shift).astype(np.int64)
        three = (((c[:-2] * _A + c[1:-1] * _B) * _B + c[2:] * _C) * _A >> shift).astype(np.int64)
        for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
            parts = [one[s:e], two[s : max(s, e - 1)], three[s : max(s, e - 2)]]
            yield np.bincount(np.concatenate(parts), minlength=DIM)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all bipartitions for up to 6 languages, else the best of seeded random codes."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    width = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        m = rng.choice(np.array([1, -1], np.int8), (n, width))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        d = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2 + 10**6 * np.eye(n, dtype=int)
        if d.min() > apart:
            best, apart = m, d.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits
    reliability: np.ndarray  # bits
    evidence: float = EVIDENCE

    def predict(self, count: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of one vector of counts."""
        n = int(count.sum())
        if not n or not self.languages:
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        f = (count @ self.weights) * (min(n, self.evidence) / n)
        loss = (np.logaddexp(0, -self.code * f) * self.reliability).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < AMBIGUOUS_MARGIN)


def held_out_rule(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, evidence: float = EVIDENCE) -> Model:
    """Learns from rows with a language that are not held out.

    About ``sample_per_language`` rows of each language, chosen by a hash of
    the text, are read whole, twice: for the n-grams of each language, every
    one counting once, and for the part of the rows that each bit's classifier
    gets right.  The driver gets a vector per language and a row per bit.
    ``evidence`` is the number of n-grams that count as independent at most.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out)
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((DIM, 0)), np.zeros(0))
    part = F.pmod(F.xxhash64(text_col), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang in languages:
        chosen |= (F.col(lang_col) == lang) & (part < int(min(1.0, sample_per_language / counts[lang]) * (1 << 20)))
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), DIM))
        for batch in batches:
            for lang, count in zip(batch.column(0).to_pylist(), ngram_counts(strings(batch, text_col))):
                total[number[lang]] += count
        for lang, k in number.items():
            if total[k].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k].tobytes()], pa.binary())], ["k", "sums"])

    total = np.zeros((len(languages), DIM))
    sums = map_arrow(labelled.where(chosen).select(lang_col, text_col), run, "k long, sums binary")
    for k, raw in sums.groupBy("k").applyInArrow(_add, "k long, sums binary").collect():  # one row per language
        total[k] = np.frombuffer(raw)
    p = (total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * DIM)
    code = codewords(len(languages))
    weights = np.zeros((DIM, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        weights[:, b] = np.log(p[yes].mean(axis=0)) - np.log(p[no].mean(axis=0))

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, rows = np.zeros(code.shape[1], np.int64), 0
        for batch in batches:
            for lang, count in zip(batch.column(0).to_pylist(), ngram_counts(strings(batch, text_col))):
                if count.any():
                    right += np.sign(count @ weights) == code[number[lang]]
                    rows += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array(np.full(len(right), rows))], ["bit", "right", "rows"])

    judged = map_arrow(labelled.where(chosen).select(lang_col, text_col), record, "bit long, right long, rows long")
    reliability = np.full(code.shape[1], LEAST_RELIABLE)
    for bit, right, rows in judged.groupBy("bit").agg(F.sum("right"), F.sum("rows")).collect():  # a row per bit
        reliability[bit] = max(LEAST_RELIABLE, 2 * right / rows - 1)  # 0 for guessing, 1 for no error
    return Model(languages, code, weights, reliability / reliability.mean() if len(reliability) else reliability, evidence)


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in t.column("sums").to_pylist())
    return pa.table({"k": t.column("k")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous added, in place of columns of those names.

    Only the text is looked at.  A null text, or one without a letter, is
    ``und`` with score 0 and ambiguous; so is every text when no language was
    learnt.  Repeated rows repeat; ties go to the first language by name; an
    empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    return _predicted(docs.select(*[f"`{c}`" for c in kept]), model, text_col, ("lang_pred", "score", "ambiguous"))


def _predicted(docs: DataFrame, model: Model, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages and bits bound its size
    columns = [*docs.columns, *names]
    schema = with_fields(docs, *zip(names, ("string", "double", "boolean")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = strings(batch, text_col)
            got = []
            for t, count in zip(texts, ngram_counts(texts)):
                has = count.any() and any(map(str.isalpha, t))
                got.append(model.predict(count) if has else (UNDETERMINED, 0.0, True))
            lang, score, doubt = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], columns)

    return map_arrow(docs, run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, with all its columns, without texts that are undetermined or ambiguous between languages.

    Where nothing was learnt, only texts without a letter go.
    """
    if not model.languages:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    lang, score, doubt = (free_name(docs, x) for x in ("lang_pred", "score", "ambiguous"))
    told = _predicted(docs, model, text_col, (lang, score, doubt))
    return told.where((F.col(lang) != UNDETERMINED) & ~F.col(doubt)).drop(lang, score, doubt)
