from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import lexicon, money, sketch
from corpusmill.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_sentences(spark):
    got = one(spark, "Kâr arttı. Ok!\nBorç düştü\nnot kesildi? A. Son…  bitti", T.split_sentences)
    assert got == ["Kâr arttı.", "Ok!", "Borç düştü not kesildi?", "Son…", "bitti"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Satış 12Mart günü\n\narttı…", "Satış 12 Mart günü arttı..."),
        ("kazandıŞirket büyüdü", "kazandı. Şirket büyüdü"),
        ("fiyat​lar 3–5 arası", "fiyatlar 3-5 arası"),
        ("A B", "A B"),
        ("   ", ""),
    ],
)
def test_preprocess(spark, raw, clean):
    assert one(spark, raw, T.preprocess) == clean


@pytest.mark.parametrize(
    ("raw", "mark"),
    [
        ("Deniz Cam 2025 yılında 12,5 milyon TL kazandı.", "deniz cam <DATE> yılında <NUM> milyon <CUR> kazandı."),
        ("Deniz Cam 2024 yılında 9 milyon USD kazandı.", "deniz cam <DATE> yılında <NUM> milyon <CUR> kazandı."),
        ("Gelir 3. çeyrek sonunda %18 yükseldi.", "gelir <QTR> sonunda <PCT> <NUM> yükseldi."),
        ("Toplantı 14.05.2026 günü.", "toplantı <DATE> günü."),
        ("Fiyat 1.250 TL oldu.", "fiyat <NUM> <CUR> oldu."),
    ],
)
def test_template(spark, raw, mark):
    assert one(spark, raw, T.template) == mark


def test_clean_sentences(spark):
    got = one(spark, "Kısa. Bu cümle yeterince uzun bir cümledir! 123456789 1234567890. Noktasız kalan uzun bir cümle", lambda x: T.clean_sentences(T.split_sentences(x)))
    assert got == ["Bu cümle yeterince uzun bir cümledir!", "Noktasız kalan uzun bir cümle."]


def test_flags_and_formats(spark):
    assert one(spark, "YÜZDE beş", T.has_money) and not one(spark, "12 adet", T.has_money)
    assert one(spark, "bu ÇEYREK", T.has_period)
    assert one(spark, "Straße  İyi\tŞey", T.norm_text).startswith("strasse i")
    assert one(spark, "a <b> & 'c'", T.html_escape) == "a &lt;b&gt; &amp; &#x27;c&#x27;"
    row = spark.range(1).select(T.thousands(F.lit(1234567)).alias("a"), T.decimal_comma(F.lit(3.14159), 1).alias("b"), T.percent(F.lit(0.1234)).alias("c")).first()
    assert tuple(row) == ("1.234.567", "3,1", "12.3%")


def test_lexicon(tmp_path, spark):
    lexicon.write_starter(str(tmp_path))
    (tmp_path / "up.txt").write_text("# x\nart\n\nçok arttı\n", encoding="utf-8")
    lexicon.write_starter(str(tmp_path))
    assert lexicon.read_lexicon(str(tmp_path / "up.txt")) == ["çok arttı", "art"]
    assert lexicon.read_lexicon(str(tmp_path / "none.txt")) == []
    assert lexicon.simple_stem("evlerinden") == "evler" and lexicon.simple_stem("kitaplarindan") == "kitap" and lexicon.simple_stem("ab") == "ab" and lexicon.simple_stem("oda") == "oda"
    assert lexicon.normalize_word(" ISI ") == "isi"
    pat = lexicon.phrase_pattern(["çok arttı", "kâr"])
    assert one(spark, "Kâr ÇOK ARTTI", lambda x: lexicon.matches(x, pat)) and not one(spark, "kârlı", lambda x: lexicon.matches(x, pat))
    assert not one(spark, "x", lambda x: lexicon.matches(x, lexicon.phrase_pattern([])))


def test_simhash_matches_a_plain_fold(spark):
    import hashlib
    import re

    def plain(s):
        toks = [t for t in re.sub(f"[^{T.TR_WORD}]", " ", s.casefold()).split() if len(t) >= 2]
        if not toks:
            return 0
        v = [0] * 64
        for t in toks:
            d = hashlib.md5(t.encode()).hexdigest()
            h = int(d[:16], 16) ^ int(d[16:], 16)
            for b in range(64):
                v[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if v[b] >= 0)

    texts = ["", "!", "kâr arttı", "Straße und mehr mehr", "a b c"]
    got = [r["h"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", sketch.simhash64(F.col("x")).alias("h")).orderBy("i").collect()]
    assert [h & (1 << 64) - 1 for h in got] == [plain(t) for t in texts]


@pytest.mark.parametrize(
    ("year", "ccy", "text", "amount", "tl"),
    [
        (2008, "USD", "$11.4 million", "11400000", "14.820.000 TL"),
        (2010, "EUR", "€60m", "60000000", "120.000.000 TL"),
        (2010, "EUR", "€82m", "82000000", "164.000.000 TL"),
        (2010, "USD", "1 bn", "1000000000", "1.500.000.000 TL"),
        (2010, "USD", "75k", "75000", "112.500 TL"),
        (2010, "EUR", "2.25", "2.25", "5 TL"),
        (2010, "USD", "10-12m", "10", "15 TL"),
        (2010, "USD", "$1,500", "1.5", "2 TL"),
    ],
)
def test_money(spark, year, ccy, text, amount, tl):
    df = spark.createDataFrame([(year, ccy, text)], "y int, c string, a string")
    row = money.convert(df, "y", "c", "a", strict_reference=True).first()
    assert row["amount_value"] == Decimal(amount) and row["tl_formatted"] == tl


def test_money_errors_and_corrected_mode(spark):
    df = spark.createDataFrame([(2010, "USD", "n/a"), (2012, "USD", "1"), (2010, "XXX", "1"), (2010, "USD", None)], "y int, c string, a string")
    assert [r["tl"] for r in money.convert(df, "y", "c", "a").collect()] == [None] * 4
    with pytest.raises(Exception):
        money.convert(df, "y", "c", "a", strict=True).collect()
    fixed = spark.createDataFrame([(2010, "USD", "10-12m"), (2010, "USD", "$1,500")], "y int, c string, a string")
    assert sorted(int(r["amount_value"]) for r in money.convert(fixed, "y", "c", "a").collect()) == [1500, 10_000_000]


def test_bucket_targets():
    fr = dict(zip("udlmrno", (0.2, 0.2, 0.15, 0.15, 0.1, 0.1, 0.1), strict=True))
    for total, want in ((20000, (4000, 4000, 3000, 3000, 2000, 2000, 2000)), (7, (1,) * 7), (33, (7, 7, 5, 5, 3, 3, 3)), (10, (1, 2, 2, 2, 1, 1, 1)), (25, (6, 5, 4, 4, 2, 2, 2))):
        assert tuple(money.bucket_targets(total, fr).values()) == want
