"""Language identification by mixture inference over the words of a text.

A model holds, per language, the log-likelihood of hashed character n-grams of words. A text is a mixture:
each word comes from one of the languages present, with unknown proportions. Expectation-maximisation
estimates the proportions, and the set of languages grows only while the log-likelihood gains more than a
penalty per language. The prediction is the language with the largest share; the score is that share.

A null text, or one without letters, is `und` with score 0. Rows without language are not learned from. With
nothing to learn from, every text is `und`. Repeated rows count as often as they occur. A null key is learned from like
others. Whole texts are learned from and read, in one task each. Columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import short_batches, small_side

BUCKETS = 1 << 16  # hashed n-grams of a language
SAMPLE = 2_000  # texts learned from per language, the bound (in the mean) of the fitted sample
SMOOTHING = 0.5
FLOOR = 12.0  # a word is at most this much (in nats) less likely in one language than in the best one
PENALTY = 6.0  # nats that a further language must gain, times the logarithm of the number of words
ROUNDS = 12
KNOWN_WORDS = 150_000
BLOCK_CHARS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")  # runs of letters
UND = "und"


def gram_buckets(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 4: start and bucket of every n-gram of the words, which are set between blanks."""
    codes = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = codes == 32
    hashed, inside = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in range(1, 5):
        size = len(codes) - n + 1
        if size <= 0:
            return
        hashed = (hashed[:size] + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)  # wraps
        if n > 2:
            inside = inside[:size] | blank[n - 2 : n - 2 + size]  # no gram reaches over a blank
        starts = np.flatnonzero(~blank if n == 1 else ~inside[:size])
        yield starts, (hashed[starts] >> np.uint64(40)).astype(np.int64) % BUCKETS


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sample(docs: DataFrame, lang: str, text: str, key: str) -> DataFrame:
    """About SAMPLE rows per language, all of them where there are fewer.

    A row is chosen by a hash of its key and text, so the same rows in every run, and no language is gathered
    in one place. The counts have a row per language.
    """
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = named.groupBy(F.col(lang).alias("_lang")).count().select("_lang", (F.lit(SAMPLE) / F.col("count")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = named.join(small_side(counts), F.col(lang) == F.col("_lang")).where(draw < F.col("_share"))
    return chosen.select(lang, text)


def count_grams(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, bucket, n): counts of the hashed n-grams, summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                for _, buckets in gram_buckets(words(value)):
                    row += np.bincount(buckets, minlength=BUCKETS)
        for name, row in totals.items():
            used = np.flatnonzero(row)
            columns = [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(row[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    return rows.select(lang, text).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods (bucket x language), and the table of words already scored."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of a block of texts that the table lacks."""
        if not self.languages:
            return
        missing = set().union(*texts).difference(self.rows)
        if len(self.rows) + len(missing) > KNOWN_WORDS:
            self.rows, self.table = {}, self.table[:0]
            missing = set().union(*texts)
        if missing:
            new = list(missing)
            lengths = np.array([len(w) + 1 for w in new])
            sums = np.zeros((int(lengths.sum()) + 1, len(self.languages)), np.float32)
            for starts, buckets in gram_buckets(new):
                sums[starts] += self.logs[buckets]
            scores = np.add.reduceat(sums, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
            scores = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -FLOOR))
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, scores])

    def predict(self, found: list[str]) -> tuple[str, float, list[tuple[str, float]]]:
        """Language, its share, and the shares of the selected languages, from the words of a text."""
        if not found or not self.languages:
            return UND, 0.0, []
        at = np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))
        chosen, shares = select_languages(self.table[at])
        order = np.argsort(-shares, kind="stable")
        mix = [(self.languages[chosen[i]], float(shares[i])) for i in order]
        return mix[0][0], min(mix[0][1], 1.0), mix

    def predict_all(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, float]]]]:
        block, size = [], 0
        for at, text in enumerate(texts):
            block.append(words(text or ""))
            size += len(text or "")
            if size > BLOCK_CHARS or at == len(texts) - 1:
                self.learn(block)
                yield from map(self.predict, block)
                block, size = [], 0


def fit_shares(likely: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the mixture shares; returns them and their log-likelihood."""
    for _ in range(rounds):
        shares = shares * ((1 / (likely @ shares)) @ likely) / len(likely)
    return shares, float(np.log(likely @ shares).sum())


def select_languages(likely: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Forward selection by penalised likelihood; a row per word, a column per language.

    The log-likelihood is concave in the shares, so a language gains less than its gradient at share zero,
    and one whose gradient is below the penalty is not tried.
    """
    single = np.log(likely).sum(axis=0)
    chosen, shares, value = [int(single.argmax())], np.ones(1), float(single.max())
    penalty = PENALTY * np.log(len(likely) + 1)
    while len(chosen) < likely.shape[1]:
        slope = (1 / (likely[:, chosen] @ shares)) @ likely - len(likely)
        slope[chosen] = 0
        fitted = []
        for extra in np.flatnonzero(slope > penalty):
            trial = [*chosen, int(extra)]
            some = np.ascontiguousarray(likely[:, trial])
            fitted.append((trial, *fit_shares(some, np.append(shares * 0.9, 0.1).astype(likely.dtype), ROUNDS)))
        best = max(fitted, key=lambda f: f[2], default=None)
        if best is None or best[2] - value <= penalty:
            break
        chosen, shares, value = best
    return chosen, shares


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows' languages. Its size is languages x BUCKETS, whatever the number of rows."""
    short_batches(docs.sparkSession)
    counts = count_grams(sample(docs, lang, text, key), lang, text).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    logs = np.log(table / table.sum(axis=1, keepdims=True)) if len(languages) else table
    return Model(languages, np.ascontiguousarray(logs.T, np.float32))


KNOWN: list[Model] = []


def worker_model(languages: list[str], logs: np.ndarray) -> Model:
    """The model of this Python worker, with the words that earlier tasks have scored."""
    if not KNOWN or KNOWN[0].languages != languages or not np.array_equal(KNOWN[0].logs, logs):
        KNOWN[:] = [Model(languages, logs)]
    return KNOWN[0]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of the rows, with lang_pred, score and the mixture of languages."""
    short_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "mixture")]
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", mixture)]
    schema = T.StructType([*docs.select(keep).schema.fields, *added])
    languages, logs = model.languages, model.logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_model(languages, logs)
        for batch in batches:
            out = list(own.predict_all(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            columns = [
                pa.array([x[0] for x in out], pa.string()),
                pa.array([x[1] for x in out], pa.float64()),
                pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in out], kind),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return docs.select(keep).mapInArrow(run, schema)
