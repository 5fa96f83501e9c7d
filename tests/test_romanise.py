import pytest
from pyspark.sql import functions as F

from tessera.functions import romanise as R
from tessera.functions import text as T

# Input and expected text. Fixed values.
PAIRS = [
    ("मेरा नाम اکیب ہے۔", "mera naam اکیب ہے۔"), ("बहुत अच्छा है।", "bahut acha hai."), ("यह कोड की ज़बान में आवाज़ की शिनाख़्त का टेस्ट है।", "yeh kod ki zaban mein awaz ki shanakht ka test hai."), ("नदी", "nadi"), ("ज़िंदगी", "zindagi"), ("बड़ा", "bara"), ("छोटा", "chota"),
    ("पानी", "pani"), ("खाना", "khana"), ("बताना", "batana"), ("लड़की", "larki"), ("प्यार", "pyar"), ("आसमान", "aasman"), ("ज्ञान", "gyan"), ("धर्म", "dharm"), ("शुक्रिया", "shukriya"), ("हम", "hum"), ("आवाज", "awaz"), ("ज़बान", "zaban"), ("नाम", "naam"), ("हूँ", "hoon"), ("हैं", "hain"),
    ("रात", "raat"), ("नाम123", "naam123"), ("करना", "karna"), ("देखना", "dekhna"), ("समझना", "samajhna"), ("आदमी", "aadmi"), ("गली", "gali"), ("बच्चा", "bacha"), ("इसलिए", "isliye"), ("सिर्फ", "sirf"), ("आदाब", "adaab"), ("क्या तुम जाओगे?", "kya tum jaoge?"), ("जगह", "jagah"),
    ("अकीब", "Aqib"), ("मोहम्मद", "Muhammad"), ("करांची", "Karachi"), ("चार", "char"), ("पाँच", "panch"), ("भाई", "bhai"), ("बहन", "behan"), ("ठंडा", "thanda"), ("क्या तुम पानी पीओगे?", "kya tum pani peoge?"), ("हम कल जाएंगे।", "hum kal jayenge."), ("", ""),
]


@pytest.mark.parametrize(("given", "expected"), PAIRS)
def test_pairs(given, expected):
    assert R.romanised(given) == expected


def test_in_spark(spark):
    df = spark.createDataFrame([*PAIRS, (None, None)], "given string, expected string")
    assert df.where(~R.romanise("given").eqNullSafe(F.col("expected"))).count() == 0


def test_endings_in_both_forms(spark):
    words = ["paanee", "khaanaa", "meraa", "aa", "lagaao", "naam", "aataa", "leeé lee.", "bataanaa do"]
    df = spark.createDataFrame([(w, R.endings(w)) for w in words], "w string, e string")
    assert [r.got for r in df.select(T.plain_endings(F.col("w")).alias("got")).collect()] == [R.endings(w) for w in words]
    assert R.endings("paanee") == "pani" and R.endings("lagaao") == "lagao" and R.endings("aataa") == "aata"


def test_lexicon():
    assert R.corrected("Men aur ali, HAM hepatitis si") == "Mein aur Ali, Hum hepatitis C"
    assert R.letters("दुः ५।") == "du 5."


@pytest.mark.parametrize(("given", "expected"), [*R.LISTED.items(), *R.LISTED_NAMES.items()])
def test_listed_forms(given, expected):
    assert R.corrected(given) == expected
