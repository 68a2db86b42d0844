"""Language identification by compression (operator 3).

Each language has a zstandard raw-content dictionary of labelled text. A text is cut into blocks, each block is
compressed with each of the DICTS dictionaries of every language, and the language with the fewest bytes in the mean wins:
the mean of several counts is finer than one byte, which decides short texts. A margin below ``min_margin`` (the relative
gain of the best over the second best) marks the text as rejected.

What is fitted is bounded: DICTS dictionaries of DICT_BYTES a language, from the SAMPLE_DOCS labelled rows with the
smallest hash of id and text. A long text gives a piece from a place that its hash chooses. All languages have
dictionaries; past some hundred of them each gets a smaller one, so that together they hold ALL_BYTES at most. They travel
with the task. Every block of every text is scored.

Edge cases: a null text, or one with no letter, is ``und`` with score 0 and rejected; ties go to the language that
sorts first; repeated rows are scored alike; with no labelled text at all every row is ``und``; an empty table gives
no rows; other columns are kept, those of the names that are added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, free, hash_bound, text_batches, without

DICTS, DICT_BYTES, SAMPLE_DOCS, ALL_BYTES = 3, 49_152, 400, 12 << 20
BLOCK = 4_096
#: Below this relative margin a text is rejected.
MIN_MARGIN = 0.001
#: Bytes of one header that every zstandard frame carries here; they say nothing about the text.
_FRAME = 6


def learn(docs: DataFrame) -> dict[str, list[bytes]]:
    """Dictionaries by language from rows with text and lang; only a bounded sample comes to the driver."""
    usable = docs.where("lang is not null and text <> ''").select("doc_id", "lang", "text")
    common = usable.groupBy("lang").count().collect()  # a row a language
    if not common:
        return {}
    size = min(DICT_BYTES, ALL_BYTES // (DICTS * len(common)))
    piece = 8 * DICTS * size // SAMPLE_DOCS
    at = F.pmod(F.col("_h"), F.greatest(F.lit(1), F.length("text") - piece + 1)).cast("int") + 1
    order, few = F.xxhash64("doc_id", "text"), Window.partitionBy("lang").orderBy("_h")
    bounds = F.create_map(*[F.lit(x) for r in common for x in (r.lang, hash_bound(SAMPLE_DOCS, r["count"]))])
    rows = (
        usable.withColumn("_h", order)
        .where(F.col("_h") <= bounds[F.col("lang")])  # about 2 x SAMPLE_DOCS rows a language, before they are dealt
        .withColumn("_n", F.row_number().over(few))
        .where(F.col("_n") <= SAMPLE_DOCS)
        .select("lang", "_n", F.substring("text", at, F.lit(piece)).alias("text"))
        .orderBy("lang", "_n")
        .collect()
    )  # at most SAMPLE_DOCS rows a language
    parts: dict[str, list[list[bytes]]] = {}
    for r in rows:
        own = parts.setdefault(r.lang, [[] for _ in range(DICTS)])
        own[r._n % DICTS].append(_prepared(r.text).encode("utf-8", "surrogatepass"))
    return {lang: [b"\n".join(p)[-size:] or b"\n" for p in own] for lang, own in sorted(parts.items())}


def _prepared(text: str) -> str:
    return " ".join(text.lower().split())


class Classifier:
    """Scores texts against the dictionaries; made once per Python worker and task."""

    def __init__(self, dictionaries: dict[str, list[bytes]]):
        self.langs = list(dictionaries)
        self.own = [[*map(self._compressor, dictionaries[lang])] for lang in self.langs]

    @staticmethod
    def _compressor(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(
            3, window_log=18, hash_log=16, chain_log=16, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def sizes(self, text: str) -> list[float]:
        """Mean bytes of the text by language, over all its blocks."""
        data = _prepared(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(max(len(c(b)) - _FRAME, 0) for b in blocks for c in own) / len(own) for own in self.own]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin)."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        size = self.sizes(text)
        order = sorted(range(len(size)), key=size.__getitem__)
        best = size[order[0]]
        if len(order) == 1:
            return self.langs[order[0]], 1.0, 1.0
        margin = (size[order[1]] - best) / max(size[order[1]], 1.0)
        # bytes saved are log-likelihood, tempered so that long texts do not all score 1
        scale = 8 / math.sqrt(max(best, 1.0))
        score = 1 / sum(math.exp(-min(50.0, (s - best) * scale)) for s in size)
        return self.langs[order[0]], score, margin


def identify(docs: DataFrame, dictionaries: dict[str, list[bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` plus lang_pred, lang_score, lang_margin and lang_rejected, in one pass without a shuffle."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([classify(t) for t in texts], columns=["lang_pred", "score", "margin"])

    p, added = free(docs, "_p"), ("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    out = docs.withColumn(p, predict(F.col("text")))
    lang, margin = F.col(f"{p}.lang_pred"), F.col(f"{p}.margin")
    rejected = (lang == "und") | (margin < min_margin)
    return out.select(*without(docs, *added), *[c.alias(n) for c, n in zip((lang, F.col(f"{p}.score"), margin, rejected), added)])


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 5) == 0
