"""Models behind one small interface: what needs weights is a scorer of the caller's, loaded once in each Python worker.

A factory (a function without arguments, which Spark can ship) makes the scorer; batches of Arrow rows go through it.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


class Scorer(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A unit vector for each text."""

    def generate(self, prompts: list[str], frames: list[list]) -> list[str]:
        """A text for each prompt with its frames (an empty list for text alone)."""

    def score(self, prompts: list[str], frames: list[list], options: int) -> np.ndarray:
        """A logit for each option of each prompt."""


Factory = Callable[[], Scorer]
_LOADED: dict[bytes, Scorer] = {}


def loaded(factory: Factory) -> Scorer:
    """The worker's scorer, made at its first use."""
    from pyspark import cloudpickle

    key = hashlib.md5(cloudpickle.dumps(factory)).digest()
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


VECTORS = T.StructType([T.StructField("_norm", T.StringType()), T.StructField("_vector", T.ArrayType(T.DoubleType()))])


def _embedded(texts: DataFrame, factory: Factory, batch: int) -> DataFrame:
    """_norm and its _vector, for different texts (_norm)."""

    def run(parts):
        scorer = loaded(factory)
        for part in parts:
            for a in range(0, len(part), batch):
                some = part["_norm"].iloc[a : a + batch].tolist()
                yield pd.DataFrame({"_norm": some, "_vector": [v.tolist() for v in np.asarray(scorer.embed(some), float)]})

    return texts.mapInPandas(run, VECTORS)


def embed(rows: DataFrame, text: str, factory: Factory, name: str = "vector", batch: int = 256, cache: VectorCache | None = None) -> DataFrame:
    """rows with the vector of a text column. Each different normalised text is embedded once and joined back; null texts have null vectors.

    With a cache, texts that it has are not embedded again, in this run or a later one.
    """
    keyed = rows.withColumn("_norm", X.normalise(text))
    texts = keyed.select("_norm").filter("_norm is not null").distinct()
    known = cache.vectors(texts, factory, batch) if cache else _embedded(texts, factory, batch)
    return keyed.join(known.withColumnRenamed("_vector", name), "_norm", "left").drop("_norm")


@dataclass(frozen=True)
class VectorCache:
    """Vectors of texts, kept between runs: Parquet in a folder of any file system Spark writes, one subfolder a model.

    Rows are (digest, norm, vector), digest the SHA-256 of the normalised text; the text itself is kept and compared. What
    is missing is found by an anti-join before the scorer, and appended once. Two runs at the same time may both append a
    text: one of its rows is taken. An append that fails leaves whole files or none.
    """

    folder: str
    model: str

    @property
    def path(self) -> str:
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(self.model.encode()).hexdigest()[:16]}"

    def known(self, spark: SparkSession) -> DataFrame:
        """digest, _norm, _vector of all that is kept."""
        schema = "digest string, norm string, vector array<double>"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = spark.read.schema(schema).parquet(self.path) if there else spark.createDataFrame([], schema)
        return rows.select("digest", F.col("norm").alias("_norm"), F.col("vector").alias("_vector"))

    def vectors(self, texts: DataFrame, factory: Factory, batch: int = 256) -> DataFrame:
        """_norm, _vector of different texts (_norm), of which those that are new are embedded and appended now."""
        spark = texts.sparkSession
        asked = texts.withColumn("digest", F.sha2("_norm", 256))
        new = asked.join(self.known(spark).select("digest", "_norm"), ["digest", "_norm"], "left_anti").select("_norm")
        found = _embedded(new, factory, batch).select(F.sha2("_norm", 256).alias("digest"), F.col("_norm").alias("norm"), F.col("_vector").alias("vector"))
        found.write.mode("append").parquet(self.path)
        return asked.join(self.known(spark), ["digest", "_norm"]).dropDuplicates(["digest", "_norm"]).select("_norm", "_vector")


@dataclass(frozen=True)
class Batches:
    """How rows are put together for a model that pads its batches to the longest prompt.

    A batch ends where another row would make it more than `rows` rows or `tokens` tokens with padding (a longer row is a
    batch of its own), or padding more than `padding` of these. Rows come to it by length, so both are rare.
    """

    rows: int = 4
    tokens: int = 1 << 16
    padding: float = 0.1
    frame_tokens: int = 64

    def cut(self, lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
        """[start, end) of each batch of consecutive lengths."""
        start, end, top, total = 0, 0, 0, 0
        for n in lengths:
            peak, size = max(top, n), end - start + 1
            if end > start and (size > self.rows or size * peak > self.tokens or size * peak - total - n > self.padding * size * peak):
                yield start, end
                start, peak, total = end, n, 0
            top, total, end = peak, total + n, end + 1
        if end > start:
            yield start, end


#: Columns that tell what an answer cost: tokens of its prompt, padding before it, rows of its batch, seconds of its share of the batch, seconds to the batch's first token.
COSTS = (("prompt_tokens", T.LongType()), ("padded_tokens", T.LongType()), ("batch_rows", T.IntegerType()), ("seconds", T.DoubleType()), ("first_seconds", T.DoubleType()))


def _lengths(scorer: Scorer, piece: pd.DataFrame, prompt: str, frames: str | None, how: Batches) -> list[int]:
    """Tokens of each prompt with its frames: the scorer's own count if it has one (tokens), else words and frame_tokens a frame."""
    texts, shown = piece[prompt].fillna("").tolist(), _frames(piece, frames)
    if hasattr(scorer, "tokens"):
        return [int(n) for n in scorer.tokens(texts, shown)]
    return [len(t.split()) + how.frame_tokens * len(f) for t, f in zip(texts, shown, strict=True)]


def _answers(rows: DataFrame, schema: T.StructType, prompt: str, factory: Factory, frames: str | None, how: Batches, answer) -> DataFrame:
    """Rows of similar length meet in a task's batches: they are sorted by length within the tasks they are in, without a shuffle."""

    def run(parts):
        scorer, rest = loaded(factory), None

        def done(piece, lengths):
            began = time.perf_counter()
            found = answer(scorer, piece)
            took = time.perf_counter() - began
            first = getattr(scorer, "first_token_seconds", None)
            top = max(lengths)
            cost = {"prompt_tokens": lengths, "padded_tokens": [top - n for n in lengths], "batch_rows": len(piece), "seconds": took / len(piece), "first_seconds": took if first is None else float(first)}
            return piece.assign(**found, **cost)[schema.names]

        for part in parts:
            if part.empty:
                continue
            lengths = _lengths(scorer, part, prompt, frames, how)
            if rest is not None:
                part, lengths = pd.concat([rest[0], part], ignore_index=True), rest[1] + lengths
            cuts = list(how.cut(lengths))
            for a, b in cuts[:-1]:
                yield done(part.iloc[a:b], lengths[a:b])
            # The last batch may go on in the next part.
            a = cuts[-1][0]
            rest = part.iloc[a:], lengths[a:]
        if rest is not None:
            yield done(*rest)

    size = F.length(F.coalesce(F.col(prompt), F.lit("")))
    if frames:
        size = size + 4 * how.frame_tokens * F.coalesce(F.array_size(frames), F.lit(0))
    return rows.sortWithinPartitions(size).mapInPandas(run, schema)


def _with(rows: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*rows.schema.fields, *fields, *(T.StructField(n, t) for n, t in COSTS)])


def _frames(piece: pd.DataFrame, frames: str | None) -> list[list]:
    return [[] if f is None else list(f) for f in piece[frames]] if frames else [[] for _ in range(len(piece))]


def generate(rows: DataFrame, prompt: str, factory: Factory, frames: str | None = None, name: str = "response", batch: int | Batches = 4) -> DataFrame:
    """rows with a generated text for each prompt, and COSTS."""
    how = batch if isinstance(batch, Batches) else Batches(batch)
    return _answers(rows, _with(rows, T.StructField(name, T.StringType())), prompt, factory, frames, how, lambda s, p: {name: s.generate(p[prompt].fillna("").tolist(), _frames(p, frames))})


def choose(rows: DataFrame, prompt: str, factory: Factory, options: int, frames: str | None = None, batch: int | Batches = 4) -> DataFrame:
    """rows with the logits of the options, the letter of the largest (the first of equals), and COSTS."""
    how = batch if isinstance(batch, Batches) else Batches(batch)
    fields = _with(rows, T.StructField("logits", T.ArrayType(T.DoubleType())))
    got = _answers(rows, fields, prompt, factory, frames, how, lambda s, p: {"logits": [x.tolist() for x in np.asarray(s.score(p[prompt].fillna("").tolist(), _frames(p, frames), options), float)]})
    return got.withColumn("letter", X.chosen(F.col("logits")))


def caption(chunks: DataFrame, factory: Factory, prompt: str, frames: str = "frames", batch: int | Batches = 4) -> DataFrame:
    """chunks (video, chunk, mid, frames, ...) with a caption each, and COSTS; all null for a chunk without frames, which the model does not see."""
    asked = generate(chunks.filter(F.size(frames) > 0).withColumn("_prompt", F.lit(prompt)), "_prompt", factory, frames, "caption", batch).drop("_prompt")
    none = chunks.filter(F.col(frames).isNull() | (F.size(frames) <= 0))
    return asked.unionByName(none, allowMissingColumns=True)


def observed(answers: DataFrame, name: str = "costs") -> tuple[DataFrame, Observation]:
    """answers, and an observation of their totals, which is there once answers has been written: answers, prompt_tokens, padded_tokens, batches, seconds, slowest_first.

    A task that is run again counts once; answers that are computed twice are observed at their first action.
    """
    seen = Observation(name)
    count = [F.count("seconds").alias("answers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "padded_tokens"))]
    time_of = [F.round(F.coalesce(F.sum(1 / F.col("batch_rows")), F.lit(0.0)), 6).alias("batches"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.max("first_seconds").alias("slowest_first")]
    return answers.observe(seen, *count, *time_of), seen
