"""The pipeline's rows hold the decoded text of their token ids."""

from ledgerlake.llm import bpe
import corpus_pipeline
from tests.llm.tables import SF


def test_run_keeps_the_decoded_text(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 500
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_decoding_works_in_bounded_pieces(spark):
    ids = [[5, 6, 7], [], [9] * 1000, None, [11]]
    df = spark.createDataFrame([(i, "x", x) for i, x in enumerate(ids)], "doc_id long, more string, ids array<int>").coalesce(1)
    bpe_ = bpe.tokenizer(bpe.default_path())
    got = {r.doc_id: r for r in bpe.with_decoded(df, most=4).collect()}
    for i, x in enumerate(ids):
        assert got[i].ids == x and got[i].more == "x"
        assert got[i].decoded == (None if x is None else b" ".join(bpe_._bytes[t] for t in x).decode())
