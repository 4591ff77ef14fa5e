"""Embeddings of files behind a cache: a vector is made once for a text and a model.

The cache is a table (hash, model, vector) of ``Versions``, to which each run appends what it made. Only texts that are not in it go to the model, each
text once, in batches of a task; a model is a function that takes texts and gives vectors. Blank and null texts have no vector. Without a model a
stand-in is used: how often the tokens fall on each of DIMENSIONS first digits of their hash, as a unit vector.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.relational import FILES_SQL
from corpuscle.sources.tables import files
from corpuscle.sources.versions import Versions

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIMENSIONS = 16
BATCH = 100
CACHE = "hash string, model string, vector array<double>"
_TOKEN = re.compile("[a-z0-9]+")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def token_shares(texts: list[str]) -> list[list[float] | None]:
    """The stand-in for a model; None for a text without a token."""
    out: list[list[float] | None] = []
    for t in texts:
        counts = [0] * DIMENSIONS
        for token in _TOKEN.findall(t.lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[0], 16)] += 1
        size = math.sqrt(sum(n * n for n in counts))
        out.append([n / size for n in counts] if size else None)
    return out


def made(texts: DataFrame, model: str, embed: Callable[[list[str]], list[list[float] | None]]) -> DataFrame:
    """CACHE rows of ``texts`` (hash, text), BATCH at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * part.num_rows, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], names=["hash", "model", "vector"])

    return texts.select("hash", "text").mapInArrow(run, CACHE)


def embedded(docs: DataFrame, cache: Versions, model: str = "token-shares", embed: Callable[[list[str]], list[list[float] | None]] = token_shares) -> DataFrame:
    """file_id, vector, fate of ``docs`` (file_id, extracted_text): cached, embedded now, or skipped as blank. The cache has one version more if
    anything was made."""
    hash_ = F.when(F.trim("extracted_text") != "", F.sha2("extracted_text", 256))
    hashed = docs.select("file_id", "extracted_text", hash_.alias("hash"))
    known = cache.read("vectors").where(F.col("model") == model) if "vectors" in cache.tables() else docs.sparkSession.createDataFrame([], CACHE)
    asked = hashed.where("hash is not null")
    misses = asked.join(known.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("extracted_text").alias("text"))
    base = cache.latest()
    new = made(misses, model, embed)
    cache.commit(appended={"vectors": new}, base=base)
    fresh = cache.read("vectors").where(F.col("model") == model)
    found = hashed.select("file_id", "hash").join(fresh.select("hash", "vector"), "hash", "left").join(known.select("hash", F.lit(True).alias("held")), "hash", "left")
    fate = F.when(F.col("hash").isNull(), "skipped").when(F.col("held"), "cached").otherwise("embedded")
    return found.select("file_id", "vector", fate.alias("fate"))


def shares_text(vector) -> Column:
    """The positive components of a vector by their digits, to five places, as SQL writes doubles: exponents below 1e-4 alone, and of two digits."""
    digit = lambda i: F.substring(F.lit("0123456789abcdef"), i + 1, 1)
    plain = lambda v: F.regexp_replace(v.cast("decimal(20,5)").cast("string"), r"(\.\d+?)0+$", "$1")
    small = lambda v: F.concat(F.round(v * 100000).cast("long").cast("string"), F.lit("e-05"))
    number = lambda v: F.when((v > 0) & (v < 0.0001), small(v)).otherwise(plain(v))
    return F.array_join(F.filter(F.transform(vector, lambda v, i: F.when(v > 0, F.concat(digit(i), F.lit(":"), number(F.round(v, 5))))), lambda s: s.isNotNull()), " ")


_SHARES_SQL = """tk as (select file_id, unnest(regexp_extract_all(lower(extracted_text), '[a-z0-9]+')) as token from files),
ct as (select file_id, md5(token)[1] as digit, count(*) as n from tk group by all), nm as (select file_id, sqrt(sum(n * n)) as size from ct group by 1),
vc as (select file_id, string_agg(digit || ':' || round(n / size, 5), ' ' order by digit) as vector from ct join nm using (file_id) group by 1)"""


@query(f"""with {FILES_SQL}, {_SHARES_SQL}, first as (select distinct sha256(extracted_text) as hash from files where file_id % 2 = 1 and file_kind = 'processed' and trim(extracted_text) <> '')
select file_id, vector, case when trim(extracted_text) = '' then 'skipped' when sha256(extracted_text) in (select hash from first) then 'cached' else 'embedded' end as fate from files left join vc using (file_id) where file_kind = 'processed'""")
def emb_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files embedded in two runs over one cache: the second one makes vectors of texts that the first has not seen."""
    cache = Versions(spark)
    f = files(spark, sf_dir).where("file_kind = 'processed'")
    embedded(f.where("file_id % 2 = 1"), cache)
    found = embedded(f, cache)
    return found.select("file_id", shares_text("vector").alias("vector"), "fate")
