"""Which encoding bytes without a mark are in, by how well what they decode to hangs together.

Every encoding that can decode the bytes is scored by pairs of neighbours: of the characters beyond ASCII, what share stands where
text has such characters. In alphabets an accented letter stands beside another letter of its script; in Chinese, Japanese and
Korean most characters are of the frequent region of the character set, which is laid out by frequency, and some are of the
commonest of all. The best score decides if it is coherent at all; East Asian encodings are only tried in turn if none is.
Words of accented letters only are words of Cyrillic or Greek letters too: such a reading must also be likelier than the Latin one
by how often its letters are used, and by the words of ASCII around.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A score below this is no evidence.
COHERENT = 0.1
#: Bytes that are looked at; a longer text is judged by its beginning and decoded whole.
LOOKED_AT = 1 << 20

# Marks at the beginning of a file, the longer ones first.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
# Encodings of alphabets and of East Asian scripts, in the order in which equals win.
ALPHABETS = ["cp1252", "cp1251", "iso8859_7", "cp1250"]
EAST_ASIAN = ["gb18030", "big5", "euc_kr", "shift_jis", "euc_jp"]
# Lead bytes of the frequent region, and the commonest characters.
FREQUENT = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc_kr": (0xB0, 0xC8)}
COMMON = {
    "gb18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用",
    "big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用",
    "euc_kr": "이다는의에을가고한로지도를사기하시어은리일들과자정대인으서있그해수보나것만아",
}
_PUNCTUATION = set("«»“”‘’„–—…·•°§€£©®™¿¡ªº×№、。，．；：？！「」『』（）《》　")


def _weights(said: str) -> dict[str, float]:
    """Logarithms of how often letters are used, of "parts:letters" by spaces."""
    return {c: math.log(float(n)) for n, letters in (x.split(":") for x in said.split()) for c in letters}


# Parts in a hundred of the letters beyond ASCII, about, in western Latin, Cyrillic and Greek texts; rarer ones are a tenth.
LATIN = _weights("20:é 7:äöüóáíàèç 4:ñãåøú 3:êßæ 1:õâôîûù .5:ëïòìðþýœ")
OTHERS = {
    "cp1251": _weights("10:о 8:еаи 6:нтс 4.5:рвл 3:кмдпу 1.8:яыьгзбчі 1:йхжшюц .4:щэфъјїєёў"),
    "iso8859_7": _weights("10:αοιετ 6:νσ 4:ςηυρκπμ 2.5:λίόάέ 1.5:ωγδήύ 1:θχφβώ .4:ξζψ"),
}
# Common words without accents of western languages that have accents; those that are English words too are left out.
WESTERN = frozenset(
    "de la le les et des du une est que qui dans pour avec elle sur pas ce il au aux der das und den dem von zu mit ist ein eine nicht auf el los las en y un con del una por para se su lo al es os um uma com da "
    "na che di della non ed att det som av er og til ikke het een".split()
)
#: What speaks for Latin: a run of accented letters beside one of ASCII, a western word; and for others: each further letter in a run.
TOUCHES, WORD, RUN = 4.0, 3.0, 0.75
_RARE = math.log(0.1)
_BEYOND = re.compile(f"[^\\x00-\\x7f\\xa0{''.join(sorted(_PUNCTUATION))}]+")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").partition(" ")[0]


def alphabet_score(text: str) -> float:
    """Of the characters beyond ASCII, the share that are letters beside a letter of the same script (in Latin, or of ASCII), or usual
    marks; a capital inside a word is no such letter, nor is one of a script that most of the others are not of, nor one of another
    script than Latin beside a letter of ASCII. A letter that is a word by itself counts half: such words are in every alphabet."""
    high = [k for k, c in enumerate(text) if c > "\x7f"]
    if not high:
        return 1.0
    scripts: dict[str, int] = {}
    for k in high:
        if text[k].isalpha():
            scripts[_script(text[k])] = scripts.get(_script(text[k]), 0) + 1
    main = max(scripts, key=scripts.get) if scripts else "LATIN"
    good = 0
    for k in high:
        c, before, after = text[k], text[k - 1 : k], text[k + 1 : k + 2]
        if c in _PUNCTUATION:
            good += 1
        elif c.isalpha() and _script(c) == main:
            fits = lambda x: bool(x) and (x.isalpha() and (x <= "\x7f" and main == "LATIN" or x > "\x7f" and _script(x) == main))
            ascii_letter = lambda x: x <= "\x7f" and x.isalpha()
            crowded = main == "LATIN" and before > "\x7f" and after > "\x7f"  # accents seldom stand in rows
            mixed = main != "LATIN" and (ascii_letter(before) or ascii_letter(after))
            alone = not before.isalnum() and not after.isalnum()
            good += 0.5 if alone else (fits(before) or fits(after)) and not crowded and not mixed and not (c.isupper() and before.islower())
    return good / len(high)


def likelier(latin: str, other: str, encoding: str) -> bool:
    """Whether the reading in another alphabet is as likely as the Latin one of the same bytes, or more."""
    odds, some, weights = 0.0, False, OTHERS[encoding]
    ascii_letter = lambda x: x <= "\x7f" and x.isalpha()
    for run in _BEYOND.finditer(latin):
        at = [k for k in range(*run.span()) if latin[k].isalpha() or other[k].isalpha()]
        if at:
            some = True
            odds += sum(weights.get(other[k].lower(), _RARE) - LATIN.get(latin[k].lower(), _RARE) for k in at)
            touches = ascii_letter(latin[at[0] - 1 : at[0]]) or ascii_letter(latin[at[-1] + 1 : at[-1] + 2])
            odds += -TOUCHES if touches else RUN * (len(at) - 1)
    return not some or odds >= WORD * sum(w in WESTERN for w in re.findall("[a-z]+", latin.lower()))


def east_asian_score(text: str, encoding: str) -> float:
    """Half for characters of the frequent region, or kana, and half for the commonest ones, of which a tenth is plenty."""
    high = [c for c in text if c > "\x7f" and c not in _PUNCTUATION]
    if not high:
        return 1.0 if any(c > "\x7f" for c in text) else 0.0
    if encoding in ("shift_jis", "euc_jp"):
        kana = sum("ぁ" <= c <= "ヾ" for c in high) / len(high)
        kanji = sum("一" <= c <= "鿿" for c in high) / len(high)
        return min(1.0, 4 * kana) * (kana + kanji) if kana > 0.1 else 0.0
    low, top = FREQUENT[encoding]
    leads = [c.encode(encoding, "replace") for c in high]
    frequent = sum(len(b) == 2 and low <= b[0] <= top and (b[1] >= 0xA1 or encoding == "big5") for b in leads) / len(high)
    common = sum(c in COMMON[encoding] for c in high) / len(high)
    return frequent * (0.5 + 0.5 * min(1.0, 10 * common))


def detected(data: bytes) -> tuple[str, float] | None:
    """(encoding, score) of the most coherent reading, or None."""
    part, best, latin = data[:LOOKED_AT], None, None
    for encoding in [*ALPHABETS, *EAST_ASIAN]:
        try:
            text = part.decode(encoding, "strict" if len(part) == len(data) else "ignore")
        except UnicodeDecodeError:
            continue
        score = alphabet_score(text) if encoding in ALPHABETS else east_asian_score(text, encoding)
        if encoding == ALPHABETS[0] and score > COHERENT:
            latin = text
        if score > COHERENT and (best is None or score > best[1] + 1e-9) and (latin is None or encoding not in OTHERS or likelier(latin, text, encoding)):
            best = encoding, score
    return best


def decoded(data: bytes) -> str:
    """By its mark; else UTF-8 if it is that; else the most coherent encoding; else the first East Asian one that fits; else UTF-8 with
    replacements."""
    for mark, encoding in MARKS:
        if data.startswith(mark):
            return data.decode(encoding, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    if found := detected(data):
        return data.decode(found[0], "replace")
    for encoding in EAST_ASIAN:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def texts(rows: DataFrame, content: str = "content", name: str = "text") -> DataFrame:
    """``rows`` with their bytes read as text; null bytes are a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else decoded(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], [*batch.schema.names[:-1], name])

    kept = rows.drop(content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{name}` string"
    return rows.select(*kept.columns, F.col(content).alias("_bytes")).mapInArrow(run, schema)
