"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs:

1. quality classifier: documents that it rejects go;
2. SimHash near-dedup: one document of each group stays;
3. PII: personal data in the texts is replaced by tags;
4. mixing: every document as often as its source's target weight asks for;
5. BPE: the token ids of each row, and the text that they decode to.

All but the last return the columns of documents; the pipeline's rows are doc_id,
n_tokens, ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import bpe, mixing, pii, quality_classifier, simhash
from ledgerlake.llm import common as C

STAGES = [
    ("quality classifier", quality_classifier.keep_good),
    ("SimHash near-dedup", simhash.keep_one_of_each),
    ("PII", pii.redact_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("BPE encoding and decoding", bpe.codec_stage),
]

#: Training dictionaries and merging by rank have no SQL form: the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), C.staged()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = C.stage(docs, f"pipeline-{i + 1}")
        C.drop_staged(spark, [p for p in C.staged()[:-1] if p not in before])  # all but this stage's table
    return docs
