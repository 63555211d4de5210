"""Quality bands on tables full of copies."""

import numpy as np

from ledgerlake.llm import common as C, quality_rules
from tests.llm.tables import SF


def test_copies_of_one_text_do_not_move_the_bands(spark):
    C.prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de'").selectExpr("doc_id", "lang", "text")
    rng = np.random.default_rng(3)
    junk = " ".join("".join(rng.choice(list("qxzjkvw#$%")) for _ in range(9)) for _ in range(120))

    def kept(extra):  # of the documents, among 2 copies of the extra text for each of them
        more = docs.selectExpr("-1L as doc_id", "lang").crossJoin(spark.createDataFrame([(extra,)] * 2, "text string"))
        rows = quality_rules.judge(C.stage(quality_rules.measure(docs.unionByName(more)), "test")).collect()
        return {r.doc_id: r.kept for r in rows if r.doc_id != -1}, {r.kept for r in rows if r.doc_id == -1}

    alone = {r.doc_id: r.kept for r in quality_rules.judge(C.stage(quality_rules.measure(docs), "test")).collect()}
    assert sum(alone.values()) > 80
    measured = quality_rules.measure(docs).where("n_words >= 50").orderBy("chars_per_token").collect()
    clean = next(r for r in measured[len(measured) // 2 :] if alone[r.doc_id]).doc_id
    text = docs.where(f"doc_id = {clean}").first().text
    assert kept(text) == (alone, {True})
    others, copies = kept(junk)
    assert copies == {False} and sum(others[i] != alone[i] for i in alone) <= 1  # one text more may move a quartile by one
