"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B

UNDETERMINED = "und"
#: Bounds of what is learned: about so many documents of each language (by hash of doc_id), and n-grams kept of each.
SAMPLE_DOCS, GRAMS, MAX_GRAMS = 4000, 20_000, 2_000_000
#: Languages up to which their counts are broadcast to the documents.
BROADCAST_LANGUAGES = 10_000
GRAM, HASHES, BITS_PER_GRAM = 4, 3, 24

_U = np.uint64
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (with three letters or more) of folded texts as numbers, and the text that each stands in."""
    buf, starts = B.joined(texts)
    folded = _FOLD[buf]
    n = max(0, len(buf) - GRAM + 1)
    code, solid = np.zeros(n, _U), np.zeros(n, np.int8)
    for j in range(GRAM):
        code = code << _U(8) | folded[j : j + n].astype(_U)
        solid += folded[j : j + n] != 0x20
    at = np.flatnonzero(solid >= GRAM - 1)
    owner = np.searchsorted(starts, at, side="right") - 1
    inside = at + GRAM <= starts[owner + 1]  # up to the line feed after the text, never into the next
    return code[at[inside]], owner[inside]


def _positions(code: np.ndarray, size: int) -> list[np.ndarray]:
    h = B.mix(code + _U(0x51ED270B))
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """Row p of ``slices`` holds bit p of every language's Bloom filter, 64 languages to a word."""

    languages: list[str]
    slices: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, (most * BITS_PER_GRAM - 1).bit_length())
        slices = np.zeros((max(1, -(-len(languages) // 64)), size), _U)
        for i, name in enumerate(languages):
            for p in _positions(grams[name].astype(_U), size):
                slices[i // 64, np.unique(p)] |= _U(1 << i % 64)
        fill = np.array([np.mean(slices[i // 64] >> _U(i % 64) & _U(1)) for i in range(len(languages))])
        return cls(languages, slices, fill**HASHES)

    def coverage(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language, the share of n-grams found, less the share that chance alone would find."""
        code, owner = _grams(texts)
        total = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        spots = _positions(code, self.slices.shape[1])
        for w, word in enumerate(self.slices):
            mask = word[spots[0]]
            for p in spots[1:]:
                mask &= word[p]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[:, i] = np.bincount(owner[(mask >> _U(i % 64) & _U(1)).astype(bool)], minlength=len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_positive) / (1 - self.false_positive), 0, 1)


def _held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = B.Texts(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        for i, j in B.chunks(texts):
            own = texts[i:j]
            for name in sorted(set(langs[i:j])):
                code, n = np.unique(_grams([own[k] for k in np.flatnonzero(langs[i:j] == name)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS) -> LanguageFilters:
    """Filters with the most frequent n-grams of each language, from whole texts of a bounded sample of labelled rows.

    Rows without text, lang or doc_id and held-out rows teach nothing. About ``sample_docs`` rows of each language are
    read, chosen by hash; ``grams`` n-grams of each are kept, fewer beyond ``MAX_GRAMS`` in all, so what comes to the
    driver is bounded whatever the corpus.
    """
    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null").filter(~_held_out("doc_id"))
    counts = labelled.groupBy("lang").count()
    n_languages = counts.count()
    if n_languages <= BROADCAST_LANGUAGES:  # else joining would shuffle all texts by a few languages
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(counts, "lang").filter(draw * F.col("count") < sample_docs).select("text", "lang")
    counted = sample.mapInArrow(B.lean(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= grams)
    limit = max(1, MAX_GRAMS // max(1, n_languages))
    table = top.filter(F.col("rank") <= limit).select("lang", "gram").toArrow()
    names = np.array(table["lang"].to_pylist(), object)
    codes = table["gram"].to_numpy()
    return LanguageFilters.build({n: codes[names == n] for n in set(names)})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            texts = B.Texts(batch.column("text"))
            for i, j in B.chunks(texts):
                said, score, own = [], [], texts[i:j]
                cover = filters.coverage(own) if filters.languages else np.zeros((j - i, 1))
                best = cover.argmax(axis=1)
                for k, text in enumerate(own):
                    known = filters.languages and _LETTER.search(text.decode("utf-8", "replace"))
                    said.append(filters.languages[best[k]] if known else UNDETERMINED)
                    score.append(float(cover[k, best[k]]) if known else 0.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: LanguageFilters, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, text, lang_pred and score for every row of ``docs``; score is the corrected share of known n-grams.

    The language with the highest corrected share is named, the first in order of equals. A text without a letter, a null
    text, or any text where no language was learned is ``und`` with score 0. Long texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    chosen = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema), "lang_pred string, score double"])
    return chosen.mapInArrow(B.lean(_predict(shared)), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score")
