"""A corpus pipeline of five stages: toxicity, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again. Rows are
told apart by themselves, not by doc_id, which may be null or repeat; only near-dedup and substring dedup
compare ids, and there rows without an id stay and come after all others. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import mixing, packing, simhash, substring, toxicity
from pagewright.llm.queries import table, word_bpe_stream
from pagewright.plans.staging import cleaned, discard, stage

#: Weights of the sources in the first and the second half of training.
SCHEDULE = ((0.5, (3, 1, 2)), (1.0, (2, 1, 3)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the threshold of their language go; each by its own text, ids may repeat or be null."""
    return toxicity.drop_flagged(docs, toxicity.ToxicityModel.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike by five-word shingles (exact similarity 0.8 or more), the one of smallest id stays."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8, lanes=4, budget=72)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document of smaller id holds go from the text; documents left without words go."""
    stripped = substring.strip_repeats(docs, window=50)
    changed = stripped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.where("text is null or text != ''").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of training, once per copy that the mix takes. Ids may repeat or be null: positions belong to rows."""
    mark = next(f"mix_row{k}" for k in range(len(docs.columns) + 1) if f"mix_row{k}" not in {c.lower() for c in docs.columns})
    rows = stage(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    mixed = mixing.mix_sources(rows, schedule=SCHEDULE, share=1.5, repeats=2, row=mark)
    placed = mixed.select(F.col(mark).alias("placed_row"), F.explode("positions").alias("mix_position"))
    out = rows.join(placed, rows[mark] == placed["placed_row"])
    return out.orderBy("mix_position", rows["doc_id"]).select(*[rows[c] for c in docs.columns])


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that tell the order in which their files were written; none if they were not read from files."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("written_file"), F.col("_metadata.row_index").alias("written_row"))
    except AnalysisException:
        return docs, []
    number = F.coalesce(F.regexp_extract("written_file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return placed.withColumn("written_part", number), ["written_part", "written_file", "written_row"]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens of the public word BPE, in the order of training that the files hold."""
    placed, order = in_file_order(docs)
    return packing.pack_documents(placed, word_bpe_stream, window=2048, open_windows=64, order=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


@cleaned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        before = docs
    return docs
