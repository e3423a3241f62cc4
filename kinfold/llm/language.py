"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.sampling import slices
from kinfold.llm.urls import host_of
from kinfold.runtime import join_hot, materialize

#: Rows with a declared language that the text model is fitted on, in equal parts by language, and least part.
TRAIN_ROWS, LANGUAGE_ROWS = 4000, 100
#: A declared language is a class if so many texts of the table declare it; in small tables this share is enough.
LEAST_TEXTS, LEAST_SHARE = 5, 0.01
#: Trigrams overlap, so three of them count as one observation.
TEMPER = 1 / 3
#: Strength of the suffix's prior in a host's, of the corpus's in a suffix's, and of uniform in the corpus's.
HOST_STRENGTH, SUFFIX_STRENGTH, CORPUS_STRENGTH = 20.0, 20.0, 4.0
#: A document is rejected if no language reaches this posterior.
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"
#: Share of the background in each language's trigrams, and prior of a text in none of the languages.
BACKGROUND_SHARE, UNKNOWN_PRIOR = 0.1, 1e-6
_BUCKETS = 1 << 16
_PIECE = 1 << 20
# letters in lower case and all bytes of longer characters stay; everything else is a space
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)


def _buckets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each byte trigram, and which of them hold a letter in the middle."""
    wide = raw.astype(np.uint32)
    code = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)
    return ((code ^ (code >> np.uint32(15))) >> np.uint32(3)) & np.uint32(_BUCKETS - 1), raw[1:-1] != 32


class TextModel:
    """Log likelihood of trigrams under each language, and under a background of independent bytes."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, rows: list[tuple[str | None, str | None]], languages: list[str] | None = None) -> TextModel:
        """rows: (text, language). Rows of other languages than these (or any) are of the background only."""
        if languages is None:
            languages = sorted({str(lang) for _, lang in rows if lang})
        seen = np.zeros((len(languages), _BUCKETS))
        every, letters = np.zeros(256), np.zeros(_BUCKETS)
        for text, lang in rows:
            if lang:
                raw = _bytes(text)
                every += np.bincount(raw, minlength=256)
                if lang in languages:
                    bucket, letter = _buckets(raw)
                    seen[languages.index(lang)] += np.bincount(bucket[letter], minlength=_BUCKETS)
        used = np.flatnonzero(every)
        share = every[used] / max(1.0, every.sum())
        # the background's trigram mass, bucket by bucket
        for a, pa_ in zip(used, share):
            triple = np.stack([np.full(len(used) ** 2, a), np.repeat(used, len(used)), np.tile(used, len(used))]).astype(np.uint8)
            mass = pa_ * np.repeat(share, len(used)) * np.tile(share, len(used))
            code = triple[0].astype(np.uint32) * np.uint32(0x9E3779B1) + triple[1].astype(np.uint32) * np.uint32(0x85EBCA6B) + triple[2].astype(np.uint32) * np.uint32(0xC2B2AE35)
            bucket = ((code ^ (code >> np.uint32(15))) >> np.uint32(3)) & np.uint32(_BUCKETS - 1)
            keep = triple[1] != 32
            letters += np.bincount(bucket[keep], weights=mass[keep], minlength=_BUCKETS)
        background = (letters + 1e-9) / (letters + 1e-9).sum()
        smooth = (1 - BACKGROUND_SHARE) * seen / seen.sum(axis=1, keepdims=True).clip(1.0) + BACKGROUND_SHARE * background
        return cls(languages, np.log(np.vstack([smooth, background[None]])).T.astype(np.float32).copy())

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages and background, trigram counts); long texts are summed piece by piece."""
        out, sizes = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            raw = _bytes(text)
            for at in range(0, len(raw) - 2, _PIECE):
                bucket, letter = _buckets(raw[at : at + _PIECE + 2])
                bucket = bucket[letter]
                # a histogram costs more than a gather only on short texts
                out[i] += self.table[bucket].sum(axis=0, dtype=np.float64) if len(bucket) < _BUCKETS else np.bincount(bucket, minlength=_BUCKETS) @ self.table
                sizes[i] += len(bucket)
        return out, sizes


def _sample(labelled: DataFrame, text: Column, declared: Column, train_rows: int) -> tuple[list[str], list]:
    """(classes, (text, language) of the texts that hash lowest, as many of each class and of all other languages).

    Texts are counted by language over the whole table first, so a language's part doesn't depend on its share. The
    counts give the share of hashes that holds about twice the part, so no task or driver sorts more.
    """
    spark = labelled.sparkSession
    hashed = labelled.select(text.alias("text"), declared.cast("string").alias("lang")).filter("lang <> ''").withColumn("hash_", F.xxhash64("text", "lang"))
    hashes = materialize(hashed.select("lang", "hash_").distinct(), "hashes")
    total = hashes.count()
    least = min(LEAST_TEXTS, LEAST_SHARE * total)
    counts = dict(hashes.groupBy("lang").count().filter(F.col("count") >= least).collect())
    part = max(LANGUAGE_ROWS, train_rows // max(1, len(counts)))
    cut = lambda n: min(1.0, 2.0 * (part + 32) / max(1, n))
    cuts = spark.createDataFrame([(lang, cut(n)) for lang, n in counts.items()], "lang string, cut double")
    drawn = hashes.join(F.broadcast(cuts), "lang", "left").filter(F.col("hash_") / 2.0**64 + 0.5 <= F.coalesce("cut", F.lit(cut(total - sum(counts.values())))))
    by_class: dict[str | None, list[int]] = {}
    for lang, h in drawn.select(F.when(F.col("cut").isNotNull(), F.col("lang")), "hash_").collect():
        by_class.setdefault(lang, []).append(h)
    picked = spark.createDataFrame([(h,) for found in by_class.values() for h in sorted(found)[:part]], "hash_ long")
    rows = hashed.join(F.broadcast(picked), "hash_").dropDuplicates(["hash_"]).orderBy("hash_").select("text", "lang").collect()
    return sorted(counts), rows


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", address_col: str = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, declared, language, posterior, text_language, accepted.

    Evidence: the text's likelihood under each language; the declared markup language, through how often documents
    of each language declare it; the address suffix and the host (of a url, or the plain value), as priors: counts
    of text decisions are grouped by host, suffix and corpus, and each level is smoothed with the next, the
    document's own vote left out. language is the most probable, ``und`` where independent bytes explain the text better
    by more than the prior of an unknown language allows, no posterior reaches one half, or the text has no
    letters; only ``und`` isn't accepted. Languages that fewer than LEAST_TEXTS texts declare can't be learned: a text
    with letters that would be ``und`` but declares one is taken at its word.

    The text model is fitted on about train_rows rows with a declared language, as many of each language (LANGUAGE_ROWS
    at least, where there are so many), those of lowest hash; all counts cover all rows. Null texts have no letters; null declarations and addresses count as ''. Null ids and repeated
    rows are kept. Without any declared language all is ``und``. Other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    labelled = docs.filter(F.col(declared_col).isNotNull() & text.isNotNull())
    languages, sample = _sample(labelled, text, F.col(declared_col), train_rows)
    sent = spark.sparkContext.broadcast(TextModel.fit([(r[0], r[1]) for r in sample], languages))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, sizes = sent.value.score(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores.tolist(), pa.list_(pa.float64())), pa.array(sizes)], ["doc_id", "declared", "address", "ll", "letters"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(declared_col).cast("string"), F.lit("")).alias("declared"), F.coalesce(F.col(address_col).cast("string"), F.lit("")).alias("address"), text.alias("text"))
    scored = slim.mapInArrow(likelihoods, "doc_id long, declared string, address string, ll array<double>, letters long")
    host = F.when(F.col("address").contains("://"), host_of(F.col("address"))).otherwise(F.lower("address"))
    scored = scored.withColumn("host", host).withColumn("suffix", F.regexp_extract("host", r"\.([^.]*)$", 1))
    k = len(languages)
    own = F.slice("ll", 1, k) if k else F.array().cast("array<double>")
    best = (F.array_position(own, F.array_max(own)) - 1).cast("int")
    has_text = (F.col("letters") > 0) & (TEMPER * (F.array_max(own) - F.element_at("ll", -1)) > math.log(UNKNOWN_PRIOR))
    scored = materialize(scored.withColumn("vote", F.when(has_text, best)), "scored", texts=True)
    at_word = (F.col("declared") != "") & ~F.col("declared").isin(languages) & (F.col("letters") > 0)
    if not k:
        return scored.select("doc_id", "declared", F.when(at_word, F.col("declared")).otherwise(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(UNKNOWN).alias("text_language"), at_word.alias("accepted"))

    votes = [F.sum((F.col("vote") == i).cast("double")) for i in range(k)]
    counted = lambda by: materialize(scored.groupBy(by).agg(F.array(*[F.coalesce(v, F.lit(0.0)) for v in votes]).alias(f"{by}_votes"), F.count("*").alias("n")), by)
    hosts, suffixes, declares = counted("host"), counted("suffix"), counted("declared")
    corpus = scored.agg(*[F.coalesce(v, F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(votes)]).first()
    total = [float(x) for x in corpus]
    # declarations are counted by language as hosts are
    kinds = declares.count()

    rows = scored.count()
    joined = join_hot(join_hot(join_hot(scored, hosts, "host", total=rows).drop("n"), suffixes, "suffix", total=rows).drop("n"), declares, "declared", total=rows).drop("n")
    all_votes = sum(total)
    voted = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
    size = lambda votes_: F.greatest(F.lit(0.0), F.aggregate(votes_, F.lit(0.0), lambda a, x: a + x) - voted)
    joined = joined.withColumns({f"{by}_size": size(f"{by}_votes") for by in ("host", "suffix")})

    def evidence(i: int) -> Column:
        mine = F.when(F.col("vote") == i, 1.0).otherwise(0.0)
        less = lambda votes_: F.greatest(F.lit(0.0), F.col(votes_)[i] - mine)
        p_corpus = (F.lit(total[i]) - mine + CORPUS_STRENGTH / k) / (F.lit(all_votes) - voted + CORPUS_STRENGTH)
        p_suffix = (less("suffix_votes") + SUFFIX_STRENGTH * p_corpus) / (F.col("suffix_size") + SUFFIX_STRENGTH)
        p_host = (less("host_votes") + HOST_STRENGTH * p_suffix) / (F.col("host_size") + HOST_STRENGTH)
        p_declared = (less("declared_votes") + 1.0) / (F.lit(total[i]) - mine + max(1, kinds))
        return F.log(p_host) + F.log(p_declared) + F.lit(TEMPER) * F.col("ll")[i]

    fused = joined.withColumn("log", F.array(*[evidence(i) for i in range(k)]))
    top = F.array_max("log")
    posterior = 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    name = lambda i: F.element_at(F.array(*[F.lit(x) for x in languages]), i)
    sure = F.col("vote").isNotNull() & (posterior >= LEAST_POSTERIOR)
    found = F.when(sure, name(F.array_position("log", top).cast("int"))).when(at_word, F.col("declared")).otherwise(UNKNOWN)
    return fused.select("doc_id", "declared", found.alias("language"), posterior.alias("posterior"), F.when(F.col("vote").isNotNull(), name(F.col("vote") + 1)).otherwise(UNKNOWN).alias("text_language"), (sure | at_word).alias("accepted"))


def keep_identified(docs: DataFrame, **columns) -> DataFrame:
    """docs without those whose language can't be told. Rows that repeat an id stay or go together; null ids stay."""
    from kinfold.runtime import anti_join_ids

    key = columns.get("id_col", "doc_id")
    by_id = identify(docs, **columns).groupBy(F.col("doc_id").alias(key)).agg(F.max("accepted").alias("accepted"))
    return anti_join_ids(docs, materialize(by_id.filter("not accepted").select(key), "gone"), key)
