from docloom.llm import packing, pieces


def test_words_used_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 4)
    words, seen = packing.WordEncoder("word_bpe_49k.json"), []
    model = words.model
    words.model = lambda piece: seen.append(piece) or model(piece)
    text = "haus eins zwei drei haus vier haus fünf haus sechs haus sieben haus acht haus"
    assert words.ids(text) == packing.np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert seen.count("haus") == 1


def test_plain_letters_are_normalised_as_by_the_library():
    words = packing.WordEncoder("word_bpe_49k.json")
    for k in range(0x21, ord(packing.PLAIN)):
        for text in (chr(k), "a" + chr(k), chr(k) + "É"):
            if not chr(k).isspace():  # words hold no white space
                assert text.lower() == words.library.normalizer.normalize_str(text), (k, text)


def test_tables_of_short_and_long_texts_agree(monkeypatch):
    table, text = pieces.compiled("piece_bpe_32k.model"), "▁Übergröße▁x日本\x07abcabc"
    short = table.tokens(text)
    monkeypatch.setattr(pieces, "LONGEST_LIST", 0)
    assert table.tokens(text) == short
