import pytest

from docloom.sources import charset

SAID = {
    "gb18030": ["中文文本", "计划的进度在下周会议上讨论，预算和风险也要说明。", "他们说这个系统不能用了"], "big5": ["計劃的進度在下週會議上討論，預算和風險也要說明。", "他們說這個系統不能用了"],
    "euc_kr": ["이 계획의 예산은 다음 주 회의에서 논의합니다.", "우리는 그것을 보고 있다"], "shift_jis": ["計画の進捗を来週の会議で報告します。", "これはテストです"], "euc_jp": ["計画の進捗を来週の会議で報告します。"],
    "cp1252": ["L’été dernier, les élèves ont mangé.", "Größe und Maß für Übungen", "El niño comió piñas", "naïve café – “quoted”"], "cp1251": ["Привет, как дела? Сегодня обсудим бюджет."], "iso8859_7": ["Καλημέρα κόσμε, τι κάνετε σήμερα;"],
}


@pytest.mark.parametrize("encoding", SAID)
def test_read_back(encoding):
    for t in SAID[encoding]:
        assert charset.decoded(t.encode(encoding)) == t
        assert charset.decoded(t.encode(encoding) * 40) == t * 40


def test_marks_and_rest():
    for name in ("utf-16", "utf-32", "utf-8", "utf-8-sig"):
        assert charset.decoded("Größe 中文 👍".encode(name)) == "Größe 中文 👍"
    assert charset.decoded(b"") == "" and charset.detected(b"plain") is not None
    assert charset.decoded(b"a\xffb\xfe") and charset.decoded(b"\x81\x81\x20\xff\xff")  # nothing fits well: some text all the same


def test_rows(spark):
    rows = spark.createDataFrame([(1, b"caf\xe9 au lait"), (2, None), (3, b"")], "id int, content binary")
    assert {r.id: r.text for r in charset.texts(rows).collect()} == {1: "café au lait", 2: None, 3: ""}
