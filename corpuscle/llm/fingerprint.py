"""Document fingerprints by threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

A sketch has no fixed size: it holds the hashes of a text's word shingles that fall below ``2**BITS / SCALE``. The same hashes
survive in every text, so sketches of parts merge by union, and |A n B| / |A| estimates how much of A's shingles B contains however
unequal the two are. A fingerprint is the sketch's sorted hashes in hex, 12 digits each; short texts may have an empty one.

Likeness is |A n B| / |A u B| of two sketches, 1 of two empty ones, which are equal. It depends on nothing but the sketches. Nulls: a null text is empty. Texts of fewer than SHINGLE words have one shingle, all their words; without words, none.
Documents follow one another by descending doc_id; equal ids by text, a null id after all others. Repeated rows are documents of
their own. One document is its own next; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpuscle.llm.tables import load, map_texts, small_batches

SHINGLE = 5
SEED = 7
BITS = 48
#: One hash in SCALE is kept.
SCALE = 8
DIGITS = BITS // 4
#: Ranges of documents for each shuffle partition: the more, the more even.
RANGES_EACH = 4


def sketch(text: str | None, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below 2**BITS / scale of the text's word shingles."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1) >> np.uint64(64 - BITS)
    return np.unique(hashes[hashes < np.uint64((1 << BITS) // scale)])


def as_text(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").tobytes().hex()
    return "".join([raw[i + 16 - DIGITS : i + 16] for i in range(0, len(raw), 16)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Resemblance of two sketches."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, hashes array<long> for every row of ``docs``."""
    return map_texts(docs, "doc_id long, hashes array<long>", lambda ids, texts: {"doc_id": ids, "hashes": [sketch(t, scale).astype(np.int64) for t in texts]})


def containment(a: str, b: str):
    """Share of the hashes of column ``a`` that column ``b`` has too: an estimate of how much of one text the other contains."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(hashes: str):
    """Aggregate: the sketch of all texts of a group together."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(hashes))))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt out in ranges of descending doc_id, each range followed by a copy of what comes after it.

    Columns: range, copy, doc_id, text; sorted by these, ids descending. The ids are read twice and alone, for the ranges' limits
    and their first ids; texts are shuffled once. A copy is made of the documents with a range's first id only.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    n = RANGES_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(key.alias("k"))
    limits = sorted(set(ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0] or []))

    @F.pandas_udf(IntegerType())
    def range_of(k):
        import pandas as pd

        return pd.Series(len(limits) - np.searchsorted(np.array(limits, np.int64), k.to_numpy(np.int64), side="right"), dtype="int32")

    firsts = {r["r"]: r["k"] for r in ids.select(range_of("k").alias("r"), "k").groupBy("r").agg(F.max("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # of the first range: the last one

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(k):
        import pandas as pd

        values = k.to_numpy(np.int64)
        own = len(limits) - np.searchsorted(np.array(limits, np.int64), values, side="right")
        return pd.Series([[r, before[v]] if v in before else [r] for r, v in zip(own.tolist(), values.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", key.alias("k"), F.posexplode(places(key)).alias("copy", "range"))
    return dealt.repartition("range").sortWithinPartitions("range", "copy", F.desc("k"), F.asc_nulls_first("text")).select("range", "copy", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they are; see the contract of ``op4_fingerprint``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def row(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
        changed = edited(text, following)
        new = sketch(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_text(own), as_text(new), likeness(own, new), likeness(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in small_batches(batch):
                made = []
                for place, copy, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if held is not None and held[0] != place:
                        held = None
                    if held is None and copy:
                        continue
                    text = text or ""
                    own = sketch(text)
                    if held is not None:
                        made.append(row(*held[1:], text, own))
                    held = None if copy else (place, doc_id, text, own)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True) if made else [[]] * len(schema), schema, strict=True)], schema=schema)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return in_ranges(plain).mapInArrow(run, SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(load(spark, sf_dir, "documents"))
