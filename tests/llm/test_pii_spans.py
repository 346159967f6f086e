"""Tokens and base spans of one document meet in one pass, however many there are."""

import time

from tidemark.llm import pii


def test_many_identifiers_of_one_text(spark):
    text = " ".join(f"mail: u{i}@h{i % 90}.com" for i in range(60_000))
    began = time.time()
    got = pii.detect(spark.createDataFrame([(1, text), (2, "mail: x@y.org")], "doc_id long, text string")).collect()
    assert {r.doc_id: (len(r.base), len(r.added)) for r in got} == {1: (60_000, 0), 2: (1, 0)}
    assert time.time() - began < 120


def test_which_tokens_lie_over_which_spans(spark):
    """Against all pairs of a few texts: the first kind in order that a token overlaps."""
    texts = [(1, "a +49 (30) 123-456 789 b 4111 1111 1111 1111, x@y.z.com;1.2.3.4 12345"), (2, "1.2.3.4@host.com +1 2 3 4 5 6 7 8 9 0"), (3, "plain 99 text")]
    _, found = pii.spans(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = found.collect()
    want = {}
    for t in rows:
        if t.kind == "token":
            over = [k for k in pii.KINDS for b in rows if b.kind == k and b.rid == t.rid and b.start < t.end and b.end > t.start]
            want[t.rid, t.start] = over[0] if over else None
    kept = {}
    real = pii.written
    try:
        def spy(df, name):
            out = real(df, name)
            kept[name] = out
            return out

        pii.written = spy
        pii.bootstrapped(found)
    finally:
        pii.written = real
    assert {(r.rid, r.start): r.seed for r in kept["pii-tokens"].collect()} == want and any(want.values())
