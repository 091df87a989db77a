from docloom.sources import charset


def test_words_of_accented_letters_only():
    """Latin-1 texts in which words of accented letters only also fit Cyrillic or Greek, and texts of those that must stay."""
    for t in ("Èêenvi ç un queon ouou èèêé.", "Ouwhea the of rend\ner üöö en ö dem", "Euxai la la de ééê. ééê.", "Des | ouchtre | chpavi | èèç.", "Esqueja para ñóó la gaja los un.", "Éèçé"):
        assert charset.decoded(t.encode("iso-8859-1")) == t
    said = "The function returns a list of values. {} Please see the manual for more."
    for t in ("Привет", "и не было", "файл не найден", "мама", "Это мы и они"):
        assert charset.decoded(said.format(t).encode("cp1251")) == said.format(t)
    for t in ("Καλημέρα", "το αρχείο δεν βρέθηκε"):
        assert charset.decoded(said.format(t).encode("iso8859_7")) == said.format(t)
    assert charset.decoded("№ 5 de la".encode("cp1251")) == "№ 5 de la"
