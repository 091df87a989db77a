from docloom.llm import linededup

DOCS = [(1, "a b c d e f\nonly here once\nx y"), (2, "a b c d e g\nx y\nnothing like it at all"), (3, "one more line of its own")]


def test_only_lines_that_can_go_are_looked_up(spark, monkeypatch):
    """Lines of one row and near none are most of a table, and none of them goes."""
    sizes, plain = {}, linededup.saved

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "saved", counted)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no, r.edits) for r in linededup.repeated_lines(docs).collect()}
    assert got == {(2, 0, 1, 0, 1), (2, 1, 1, 2, 0)}
    assert sizes["unique"] == 6 and sizes["kept"] == 2
    kept = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    assert kept == {1: DOCS[0][1], 2: "nothing like it at all", 3: DOCS[2][1]}
    assert sizes["marked"] == 2
