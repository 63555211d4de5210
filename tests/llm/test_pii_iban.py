"""IBANs in running text."""

from ledgerlake.llm import common as C, pii


def test_iban_followed_by_capitals_or_by_another_iban(spark):
    C.prepare(spark)
    at, es, gb = "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"
    texts = [
        f"IBAN {es} BIC CAIXESBB", f"{at} BIC", f"pay {at} {at} NOW", f"{at.replace(' ', '')} BIC", f"\U0001f600 {gb} BIC AB12 {es} EUR 5 {at}X", f"{at[:-1]}2 BIC", at,
        f"AB12 {es}",
    ]
    want = [[es], [at], [at, at], [at.replace(" ", "")], [gb, es], [], [at], [es]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(f.match, texts[r.doc_id][f.start : f.end]) for f in r.findings if f.kind == "iban"] for r in pii.find_pii(df).collect()}
    assert got == {i: [(m, m) for m in ms] for i, ms in enumerate(want)}
    clean = [r.text for r in pii.redact_stage(spark, df, "").orderBy("doc_id").collect()]
    assert clean[:2] == ["IBAN <IBAN> BIC CAIXESBB", "<IBAN> BIC"]
