"""Overlapping personal data: every found character is replaced."""

from cubiform.llm import pii


def test_overlapping_spans_are_replaced_whole(spark):
    rows = [(1, "call +1 555 0100-jo@x.com"), (2, "call +1 555 0100-jo@x.com now"), (3, "mail jo@x.com or call +1 555 0100."), (4, "nothing"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.pii_spans for r in pii.find_pii(df).collect()}
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "call [PHONE][EMAIL]", 2: "call [PHONE][EMAIL] now", 3: "mail [EMAIL] or call [PHONE].", 4: "nothing", 5: None}
    assert len(spans[1]) == 2 and spans[1][0].start < spans[1][1].stop and spans[1][1].start < spans[1][0].stop
