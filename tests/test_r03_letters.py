from docloom.sources import charset


def test_letters_that_are_words_by_themselves():
    """Latin-1 texts whose only letters beyond ASCII stand alone, or in words that pairs of Cyrillic letters also fit."""
    for t in ("La é le de de.", "unger von ö beberte", "du. Ê Ê Ê Ê du.", "Dodoco la ñ, el. La ó", "herzlich, ß, ß", "Au éèeau, ouenl. çêa, éèeau, éê"):
        assert charset.decoded(t.encode("iso-8859-1")) == t
    for t in ("Я и ты в школе, а он у реки.", "Это мы и они"):
        assert charset.decoded(t.encode("cp1251")) == t
