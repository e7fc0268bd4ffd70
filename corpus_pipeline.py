"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's input. All but the last return the columns of ``documents``.

1. language_id: texts without a letter go, and those whose bytes the language model is less sure of than of any clean text
   of their length (``language.junk_bounds``); without labels every text with a letter stays.
2. near_duplicates: of every group linked by a Jaccard similarity of 0.8 or more over five-word shingles the first row
   stays, by id and then by row; pairs to judge come from SimHash fingerprints linked in bit planes and from min-hashes; rows of one id and different texts, or without an id, are documents of their own.
3. repeated_passages: words covered by a 20-word window that an earlier document has go; documents left without words go.
4. secrets: every span found is replaced by ``[secret]``.
5. packing: texts as byte tokens, packed into sequences of several lengths.

Every stage sets the session's Arrow batches to a few megabytes, so that Python workers hold little beside the executors' heap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cuewise.llm import language, nearcopies, packing, secrets, substrings
from cuewise.llm.common import bounded_batches, quoted, read_table, stored

ORACLE_SQL = None  # learned stages and greedy packing have no SQL form


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list:
    return [F.col(quoted(name)) for name in docs.columns]


def with_text(frame: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` with a new text, and its length where it has changed."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return frame.select(*[new[name].alias(name) if name in new else F.col(quoted(name)) for name in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model, name = language.fit(docs, F.lit(True)), free_name(docs, "found")
    found = stored(language.predict(docs, model, columns_of(docs), name=name))  # stored, as the bounds are taken from all its rows
    return found.where(language.not_junk(language.junk_bounds(found, model, name=name), name=name)).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))  # stored, so that a row keeps its number
    kept = nearcopies.first_rows(rows, key_column=row).withColumnRenamed("key", row)
    return rows.join(kept, row, "left_semi").select(*columns_of(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # the other columns travel under numbers instead of names, maps as lists of their entries
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    maps = [isinstance(f.dataType, MapType) for f in others]
    slim = docs.select("doc_id", "text", *[(F.map_entries(quoted(f.name)) if m else F.col(quoted(f.name))).alias(f"c{k}") for k, (f, m) in enumerate(zip(others, maps, strict=True))])
    kept = substrings.remove_repeats(slim, with_text=True).where("n_words > n_removed")
    rest = F.from_json("rest", slim.drop("doc_id", "text").schema, substrings.EXACT_TIMES)
    back = [(F.map_from_entries(F.col(f"r.c{k}")) if m else F.col(f"r.c{k}")).alias(f.name) for k, (f, m) in enumerate(zip(others, maps, strict=True))]
    shaped = kept.select(F.col("id").alias("doc_id"), F.col("kept_text"), F.col("n_removed"), rest.alias("r")).select("doc_id", F.struct("kept_text", "n_removed").alias(free_name(docs, "kept")), *back)
    kept_name = free_name(docs, "kept")
    return with_text(shaped, docs, F.col(f"{kept_name}.kept_text"), F.col(f"{kept_name}.n_removed") > 0)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    name = free_name(docs, "found")
    found = secrets.scan(docs, columns_of(docs), name=name)
    return with_text(found, docs, F.col(f"{name}.redacted"), F.col(f"{name}.spans") != "")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.best_fit(docs, F.octet_length("text")).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
