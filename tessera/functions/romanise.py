"""Devanagari to Roman script: letters by table, then endings, then a lexicon.

One pattern takes a consonant with all that decides its vowel: a vowel sign, a virama, a nasal, or what
follows. There is no built-in Unicode normalisation in Spark, and a letter's vowel depends on what
was written before it, so this is an Arrow UDF; texts without Devanagari letters pass through untouched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and their Roman forms.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th",
    "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "w", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
}
WITH_NUKTA = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri", "ॠ": "ri", "ऍ": "e", "ऑ": "o", "ऌ": "li"}
SIGNS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o"}
NUKTA, VIRAMA, NASALS, VISARGA = "\u093c", "\u094d", "\u0901\u0902", "\u0903"
BOUNDARY = " \t\n.,!?;:।॥\"'()[]{}"

# The lexicon: words and names as the conventions write them. Fixed values. What the letters alone would give is worked out below.
WORDS = {
    "क्या": "kya", "है": "hai", "हैं": "hain", "नहीं": "nahi", "हाँ": "haan", "में": "mein", "मैं": "main", "हम": "hum", "यह": "yeh", "वह": "woh", "का": "ka", "की": "ki", "के": "ke", "को": "ko", "से": "se", "पर": "par", "तक": "tak",
    "कब": "kab", "कहाँ": "kahan", "कैसे": "kaise", "क्यों": "kyon", "क्योंकि": "kyonki", "कौन": "kaun", "कितना": "kitna", "तू": "tu", "तुम": "tum", "आप": "aap", "मेरा": "mera", "मेरी": "meri", "तेरा": "tera", "हमारा": "hamara", "तुम्हारा": "tumhara", "अपना": "apna",
    "एक": "ek", "दो": "do", "तीन": "teen", "चार": "char", "पाँच": "panch", "छह": "chhe", "सात": "saat", "आठ": "aath", "नौ": "nau", "दस": "das", "सौ": "sau", "हज़ार": "hazar", "लाख": "lakh", "और": "aur", "लेकिन": "lekin", "मगर": "magar", "अगर": "agar", "तो": "to", "इसलिए": "isliye",
    "सिर्फ": "sirf", "आदाब": "adaab", "आवाज़": "awaz", "आवाज": "awaz", "ज़बान": "zaban", "शिनाख़्त": "shanakht", "बच्चा": "bacha", "अच्छा": "acha", "प्यार": "pyar", "आसमान": "aasman", "ज्ञान": "gyan", "भाई": "bhai", "बहन": "behan", "पीओगे": "peoge", "जाएंगे": "jayenge", "जाओगे": "jaoge", "ये": "yeh", "टेक्नोलॉजी": "technology", "आजमा": "aazma",
}
NAMES = {
    "अकीब": "Aqib", "अक़ीब": "Aqib", "आक़िब": "Aqib", "अकेब": "Aqib", "अली": "Ali", "अलि": "Ali", "उमर": "Umar", "ओमर": "Umar", "उस्मान": "Usman", "मुहम्मद": "Muhammad", "मोहम्मद": "Muhammad", "अहमद": "Ahmad", "हसन": "Hassan", "हुसैन": "Hussain", "इब्राहिम": "Ibrahim", "इस्माइल": "Ismail",
    "यूसुफ़": "Yusuf", "यूसफ़": "Yousaf", "तारिक़": "Tariq", "इमरान": "Imran", "कामरान": "Kamran", "सलमान": "Salman", "आरिफ़": "Arif", "आसिफ़": "Asif", "काशिफ़": "Kashif", "शाहिद": "Shahid", "राशिद": "Rashid", "ख़ालिद": "Khalid", "मजीद": "Majeed", "बिलाल": "Bilal", "अब्दुल्लाह": "Abdullah", "नदीम": "Nadeem",
    "वसीम": "Waseem", "फ़ैसल": "Faisal", "नईम": "Naeem", "आयेशा": "Ayesha", "आइशा": "Ayesha", "फ़ातिमा": "Fatima", "मरयम": "Maryam", "ख़दीजा": "Khadija", "ज़ैनब": "Zainab", "सादिया": "Sadia", "आम्ना": "Amna", "सफ़िया": "Safia", "राबिया": "Rabia", "कराची": "Karachi", "करांची": "Karachi", "लाहौर": "Lahore",
    "इस्लामाबाद": "Islamabad", "पाकिस्तान": "Pakistan", "हिंदुस्तान": "Hindustan", "दिल्ली": "Delhi", "मुंबई": "Mumbai", "उर्दू": "Urdu",
}
PHRASES = {"hepatitis si": "hepatitis C"}

_CONS, _SIGN, _EDGE = f"[{''.join(CONSONANTS)}]", f"[{''.join(SIGNS)}]", rf"(?:\Z|[{re.escape(BOUNDARY)}]|[^\u0900-\u097f])"
_LETTER = re.compile(
    rf"""(?:(?P<gy>ज{VIRAMA}ञ)|(?P<cons>{_CONS})(?P<nukta>{NUKTA})?)
      (?:(?P<mute>{VIRAMA})|(?P<sign>{_SIGN})(?P<nasal>[{NASALS}])?|(?P<bare>[{NASALS}])|(?P<edge>(?={_EDGE}))|(?P<cluster>(?={_CONS}{NUKTA}?{_SIGN}{_EDGE}))|)
      |(?P<vowel>[{"".join(VOWELS)}])(?P<hum>[{NASALS}])?|(?P<alone>[{NASALS}])|(?P<gone>{VISARGA})|(?P<stop>[।॥])|(?P<digit>[०-९])|(?P<other>.)""",
    re.X | re.S,
)
_DEVANAGARI = re.compile("[\u0900-\u097f]")


def letters(text: str) -> str:
    """Letter by letter. An inherent vowel is dropped at a word's end, and before a last consonant with a vowel sign
    where a vowel stands before; else it is an a."""
    if not _DEVANAGARI.search(text):
        return unicodedata.normalize("NFC", text)
    out, last = [], ""
    for m in _LETTER.finditer(unicodedata.normalize("NFC", text)):
        kind = m.lastgroup
        if m["gy"] or m["cons"]:
            piece = "gy" if m["gy"] else (WITH_NUKTA.get(m["cons"], CONSONANTS[m["cons"]]) if m["nukta"] else CONSONANTS[m["cons"]])
            if m["sign"]:
                vowel = SIGNS[m["sign"]]
                piece += ("in" if vowel == "ee" else vowel + "n") if m["nasal"] else vowel
            elif m["bare"]:
                piece += "an"
            elif not (m["mute"] or m["edge"] is not None or (m["cluster"] is not None and last and last in "aeiouy")):
                piece += "a"
        elif m["vowel"]:
            piece = VOWELS[m["vowel"]] + ("n" if m["hum"] else "")
        else:
            piece = {"alone": "n", "gone": "", "stop": "."}.get(kind, m[0]) if kind != "digit" else str(ord(m[0]) - 0x966)
        out.append(piece)
        last = piece[-1:] or last
    return "".join(out)


def endings(text: str) -> str:
    """T7 in Python; functions.text.plain_endings is the same in the JVM."""
    c, v = "[bcdfghjklmnpqrstvwxyz]", "[aeiouy]"
    for pattern, to in ((r"ee\b", "i"), (rf"(?<={c})aa\b", "a"), (rf"(?<={c})aa({c}{v})\b", r"a\1"), (rf"(?<={c})aao\b", "ao")):
        text = re.sub(pattern, to, text)
    return text


# Forms that the conventions list by themselves, whatever the letters give. Fixed values.
LISTED = {
    "ham": "hum", "yah": "yeh", "ye": "yeh", "wah": "woh", "naheen": "nahi", "nahin": "nahi", "men": "mein", "sirph": "sirf", "aadaab": "adaab", "aawaaz": "awaz", "aawaaj": "awaz", "zabaan": "zaban",
    "shinaakht": "shanakht", "bachcha": "bacha", "achchha": "acha", "achcha": "acha", "pyaar": "pyar", "isalie": "isliye", "islie": "isliye", "chaar": "char", "paanch": "panch", "bahan": "behan",
    "peeoge": "peoge", "jaenge": "jayenge", "jaaenge": "jayenge", "jaaoge": "jaoge", "samajhana": "samajhna", "aasamaan": "aasman", "gyaan": "gyan", "bhaai": "bhai",
}
LISTED_NAMES = {
    "akeeb": "Aqib", "akib": "Aqib", "aqib": "Aqib", "alee": "Ali", "ali": "Ali", "umar": "Umar", "usmaan": "Usman", "muhammad": "Muhammad", "mohammad": "Muhammad", "ahamad": "Ahmad", "ahmad": "Ahmad", "hasan": "Hassan", "husain": "Hussain",
    "imaraan": "Imran", "imran": "Imran", "karaanchi": "Karachi", "karaachi": "Karachi", "karanchi": "Karachi", "karachi": "Karachi", "laahaur": "Lahore", "paakistaan": "Pakistan", "dilli": "Delhi", "mumbai": "Mumbai",
}
#: What letters and endings make of a listed word -> how it is written.
CORRECTIONS = {low: right for word, right in WORDS.items() if (low := endings(letters(word)).lower()) != right} | LISTED | PHRASES
PROPER_NOUNS = {endings(letters(word)).lower(): right for word, right in NAMES.items()} | LISTED_NAMES


def corrected(text: str, corrections: dict[str, str] = CORRECTIONS, names: dict[str, str] = PROPER_NOUNS) -> str:
    """Names first, then corrections that keep a capital, then phrases, longest first."""

    def word(m):
        low = m[0].lower()
        fixed = names.get(low)
        if fixed:
            return fixed
        fixed = corrections.get(low)
        return m[0] if not fixed else fixed[0].upper() + fixed[1:] if m[0][0].isupper() else fixed

    text = re.sub("[A-Za-z0-9]+", word, text)
    for phrase in sorted((k for k in corrections if " " in k), key=len, reverse=True):
        text = re.sub(rf"\b{re.escape(phrase)}\b", corrections[phrase], text, flags=re.I)
    return text


def romanised(text: str) -> str:
    return corrected(endings(letters(text)))


def romanise(c) -> Column:
    """T1."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else romanised(x))

    return run(c)


def nfc(c, form: str = "NFC") -> Column:
    """Unicode normalisation."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run(c)


def ascii_digits(c) -> Column:
    """Digits and full stops; visarga dropped."""
    return F.translate(c, "०१२३४५६७८९।॥" + VISARGA, "0123456789..")
