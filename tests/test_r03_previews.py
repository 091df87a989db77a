from docloom.operators import evidence


def test_previews_of_hits_that_are_dealt_out_anew(spark):
    """hits whose rows stand elsewhere each time that they are read."""
    text = "".join(f"line {k:04}\n" for k in range(400))
    docs = spark.createDataFrame([(d, text) for d in range(3)], "doc_id int, raw_text string")
    places = [(d, k, 10 * k, 10 * k + 9) for d in range(3) for k in range(400)]
    table = spark.createDataFrame([(d, k, s, e, None) for d, k, s, e in places], "doc_id int, index int, start int, end int, page_no int")
    hits = spark.createDataFrame([(*p, None, f"q{p[1]}") for p in places], "doc_id int, chunk_index int, char_start int, char_end int, page_no int, quote string")
    got = evidence.stored_previews(hits.repartition(7), table, docs, around=0).collect()
    assert {(r.doc_id, r.chunk_index, r.preview) for r in got} == {(d, k, f"line {k:04}") for d, k, _, _ in places} and len(got) == len(places)
