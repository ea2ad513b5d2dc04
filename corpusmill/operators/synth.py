"""Synthetic labelled benchmarks from template families, by hashes instead of a random stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import seeded


@dataclass(frozen=True)
class Family:
    category: str  # its id
    label: str
    difficulty: str
    template: str  # with {slots}
    note: str = ""  # why the label holds
    tone: str = ""
    name: str = ""  # Turkish name of the category
    hard: bool = False
    viewpoint: str = "investor_impact"


#: Turkish names of labels and levels.
LABEL_TR = {"negative": "negatif", "neutral": "nötr", "positive": "pozitif"}
DIFFICULTY_TR = {"clear": "açık", "nuanced": "nüanslı"}
#: What a row says about itself.
SOURCE = "synthetic_rule_based"

SLOTS: dict[str, Sequence[str]] = {
    "company": ("Anka Enerji", "Boğaz Lojistik", "Çınar Gıda", "Doruk Çelik", "Ege Tekstil", "Fırat Cam", "Göksu İlaç", "Hisar Yapı", "Irmak Sigorta", "Kule Madencilik", "Liman Bilişim", "Meriç Kimya", "Nehir Perakende", "Ova Tarım", "Pınar Kâğıt", "Sahil Turizm"),
    "pct": tuple(str(n) for n in range(3, 40)),
    "amount": tuple(str(n) for n in range(10, 990, 7)),
    "quarter": ("birinci çeyrek", "ikinci çeyrek", "üçüncü çeyrek", "dördüncü çeyrek"),
    "city": ("Adana", "Balıkesir", "Çorum", "Denizli", "Edirne", "Gaziantep", "Kayseri", "Malatya", "Trabzon"),
    "country": ("Almanya", "Fas", "Gürcistan", "İtalya", "Japonya", "Kanada", "Polonya", "Şili"),
    "person": ("Ali Kaya", "Bahar Tunç", "Ceren Ak", "Defne Oral", "Emre Sarı", "Filiz Yurt", "Hakan Er", "Leyla Güneş"),
    "date": tuple(f"{d} {m}" for m in ("Ocak", "Mart", "Haziran", "Eylül", "Kasım") for d in (3, 9, 15, 21, 27)),
    "months": ("6", "9", "12", "18", "24"),
    "low": tuple(f"1,{n}" for n in range(10)),
    "high": tuple(f"3,{n}" for n in range(10)),
}

#: The ids, labels, levels and Turkish names of the families are fixed values; the sentences and notes are our own.
FAMILIES: tuple[Family, ...] = (
    Family("earnings_upgrade", "positive", "clear", "{company} {quarter} kârını yüzde {pct} büyüttü ve yıllık tahminini yukarı çekti.", "Kâr ve tahmin birlikte yükseliyor.", name="kâr artışı ve beklenti yükseltimi"),
    Family("contract_win", "positive", "clear", "{company} {country} tarafında {amount} milyon TL değerinde yeni sipariş aldı.", "Gelecekteki gelir artıyor.", name="yeni sözleşme kazanımı"),
    Family("deleveraging", "positive", "clear", "{company} {amount} milyon TL borç kapattı, kaldıraç {high} kattan {low} kata indi.", "Borç yükü hafifliyor.", name="borçluluk azalması"),
    Family("shareholder_return", "positive", "clear", "{company} ortaklarına {amount} milyon TL kâr payı ödeyecek ve kendi paylarını toplayacak.", "Ortaklara nakit dönüyor.", name="temettü ve geri alım"),
    Family("capacity_expansion", "positive", "clear", "{company} {city} fabrikasında üretimi yüzde {pct} büyütecek hattı devreye aldı.", "Üretim ve satış olanağı büyüyor.", name="kapasite artışı"),
    Family("margin_improvement", "positive", "nuanced", "{company} ürün karmasını değiştirerek {quarter} marjını yüzde {pct} iyileştirdi.", "Kârlılık dolaylı olarak iyileşiyor.", name="marj iyileşmesi"),
    Family("earnings_warning", "negative", "clear", "{company} {quarter} kârının yüzde {pct} düştüğünü ve tahminini kıstığını bildirdi.", "Kâr ve tahmin birlikte geriliyor.", name="kâr düşüşü ve uyarı"),
    Family("contract_loss", "negative", "clear", "{company} {country} müşterisinin {amount} milyon TL tutarındaki anlaşmayı bitirdiğini açıkladı.", "Gelecekteki gelir azalıyor.", name="sözleşme kaybı"),
    Family("liquidity_pressure", "negative", "clear", "{company} nakit açığı için {amount} milyon TL borçlandı, kaldıraç {low} kattan {high} kata çıktı.", "Nakit sıkışıyor, borç artıyor.", name="likidite baskısı"),
    Family("shutdown_and_fine", "negative", "clear", "{company} {city} tesisini durdurdu ve {amount} milyon TL ceza ödeyecek.", "Üretim kaybı ve ceza birlikte geliyor.", name="üretim duruşu ve ceza"),
    Family("dividend_cut", "negative", "clear", "{company} {date} tarihinde ödenecek kâr payından nakit yetersizliği yüzünden vazgeçti.", "Ortaklara dönecek nakit kesiliyor.", name="temettü iptali"),
    Family("margin_pressure", "negative", "nuanced", "{company} girdi maliyetleri yüzünden {quarter} marj tahminini yüzde {pct} kıstı.", "Kârlılık dolaylı olarak zayıflıyor.", name="marj baskısı"),
    Family("general_assembly_notice", "neutral", "clear", "{company} ortaklarını {date} günü {city} kentinde genel kurula çağırdı.", "Olağan bir çağrı.", name="genel kurul duyurusu"),
    Family("management_change", "neutral", "clear", "{company} muhasebe müdürlüğüne {date} itibarıyla {person} geldi.", "Mali sonucu olmayan bir atama.", name="yönetim değişikliği"),
    Family("routine_filing", "neutral", "clear", "{company} {quarter} raporunu {date} günü yayımlayacağını duyurdu.", "Olağan bir takvim bildirimi.", name="rutin bildirim"),
    Family("investment_review", "neutral", "nuanced", "{company} {city} için yatırım seçeneklerini inceliyor, verilmiş bir karar yok.", "Karar da etki de belirsiz.", name="yatırım değerlendirmesi"),
    Family("loan_renewal_unchanged", "neutral", "nuanced", "{company} {amount} milyon TL kredisini aynı koşullarla {months} ay uzattı.", "Koşullar değişmiyor.", name="kredi yenileme değişikliksiz"),
    Family("legal_process_update", "neutral", "clear", "{company} süren davasında duruşmanın {date} gününe kaldığını bildirdi.", "Sonuç bildirmeyen bir ara bilgi.", name="hukuki süreç güncellemesi"),
)

PHRASES: tuple[Family, ...] = (
    Family("clear_profit_growth", "positive", "clear", "{company} {quarter} döneminde kârını yüzde {pct} büyüttü, tahminini yükseltti.", "Sonuç ve beklenti açıkça iyi.", "positive_like", "açık kâr artışı"),
    Family("clear_contract_gain", "positive", "clear", "{company} {country} için {amount} milyon TL tutarında sipariş kazandı.", "Yeni gelir açıkça belli.", "positive_like", "açık sözleşme kazanımı"),
    Family("clear_deleveraging", "positive", "clear", "{company} {amount} milyon TL borcunu erken ödedi, kaldıraç {low} kata geriledi.", "Borç açıkça azalıyor.", "positive_like", "açık borçluluk azalması"),
    Family("clear_margin_improvement", "positive", "clear", "{company} verimlilikle {quarter} marjını yüzde {pct} artırdı.", "Kârlılık açıkça iyileşiyor.", "positive_like", "açık marj iyileşmesi"),
    Family("clear_shareholder_return", "positive", "clear", "{company} {amount} milyon TL kâr payı dağıtacağını {date} günü açıkladı.", "Ortaklara açıkça nakit dönüyor.", "positive_like", "açık hissedar getirisi"),
    Family("clear_capacity_expansion", "positive", "clear", "{company} {city} hattıyla üretimini yüzde {pct} büyüttü, siparişleri hazır.", "Büyüme açıkça satışa dönüyor.", "positive_like", "açık kapasite artışı"),
    Family("clear_rating_upgrade", "positive", "nuanced", "{company} için kredi notu {date} günü bir kademe yukarı alındı.", "Borçlanma ucuzlar.", "positive_like", "açık kredi notu iyileşmesi"),
    Family("procedural_disclosure", "neutral", "clear", "{company} ortaklar toplantısının gündemini {date} günü yayımladı.", "Yalnızca usul bildirimi.", "procedural", "prosedürel bildirim"),
    Family("vague_optimism", "neutral", "nuanced", "{company} {quarter} için umutlu olduğunu söyledi, rakam vermedi.", "Somut etki yok.", "positive_like", "belirsiz kurumsal iyimserlik"),
    Family("non_binding_review", "neutral", "nuanced", "{company} {country} seçeneğini {date} gününe dek inceleyecek, bağlayıcı adım yok.", "Bağlayıcı sonuç yok.", "neutral_like", "bağlayıcı olmayan değerlendirme"),
    Family("management_change_no_impact", "neutral", "clear", "{company} yönetiminde görev {date} günü {person} adına geçti, tahminler aynı.", "Tahminler değişmiyor.", "neutral_like", "finansal etkisiz yönetim değişimi"),
    Family("unchanged_financing_rollover", "neutral", "nuanced", "{company} {amount} milyon TL kredisini {months} ay için aynı faizle çevirdi.", "Koşullar aynı.", "neutral_like", "koşulları değişmeyen finansman yenilemesi"),
    Family("legal_process_update", "neutral", "clear", "{company} davasında bilirkişi raporu {date} günü gelecek, yeni sonuç yok.", "Yeni mali sonuç yok.", "procedural", "finansal etkisiz hukuki süreç güncellemesi"),
    Family("routine_report_release", "neutral", "clear", "{company} {quarter} faaliyet raporunu {date} günü paylaştı.", "Olağan yayımlama.", "procedural", "rutin rapor yayımlama"),
    Family("clear_earnings_warning", "negative", "clear", "{company} {quarter} kârının yüzde {pct} eridiğini duyurdu, tahminini kıstı.", "Sonuç ve beklenti açıkça kötü.", "negative_like", "açık kâr düşüşü uyarısı"),
    Family("clear_production_halt", "negative", "clear", "{company} {city} üretimini durdurdu, {amount} milyon TL ceza ayırdı.", "Kayıp açıkça belli.", "negative_like", "açık üretim duruşu ve ceza"),
    Family("hard_liquidity_pressure", "negative", "hard", "{company} esnekliğini güçlendirmek için {amount} milyon TL ek borç aldı, kaldıraç {high} kata çıktı.", "Olumlu dilin altında borç artıyor.", "positive_like", "olumlu dille likidite baskısı", True),
    Family("hard_dividend_cut", "negative", "hard", "{company} büyümeye odaklanmak için {date} kâr payını dağıtmama kararı aldı.", "Olumlu dilin altında ödeme kesiliyor.", "positive_like", "olumlu dille temettü iptali", True),
    Family("hard_contract_loss", "negative", "hard", "{company} portföyünü sadeleştirirken {country} tarafındaki {amount} milyon TL sözleşmeyi bıraktı.", "Olumlu dilin altında gelir kaybı var.", "positive_like", "olumlu dille sözleşme kaybı", True),
    Family("hard_rights_issue", "negative", "hard", "{company} özkaynağını sağlamlaştırmak için yüzde {pct} bedelli artırıma {date} günü başlayacak.", "Olumlu dilin altında paylar sulanıyor.", "positive_like", "olumlu dille bedelli sermaye artırımı", True),
    Family("hard_inventory_writeoff", "negative", "hard", "{company} bilançosunu temizleyerek {quarter} için {amount} milyon TL stok zararı yazdı.", "Olumlu dilin altında zarar yazılıyor.", "positive_like", "olumlu dille değer düşüklüğü", True),
)
#: Contexts tried for each wanted row before a family counts as too poor.
TRIES = 8


def pick(values: Sequence[str], seed: str, *keys: Column) -> Column:
    """One of the values, chosen by a hash of the keys."""
    h = F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, values)), (h % len(values)).cast("int"))


def _rows(spark: SparkSession, families: Sequence[Family], per_family: int, seed: str, prefix: str, tries: int) -> DataFrame:
    """(id, text, family): per_family different texts of each family, in seeded order.

    tries x per_family contexts are made for each family and equal texts are dropped; a family
    that can't yield enough is an error, never an endless search.
    """
    n = len(families)
    grid = spark.range(n * per_family * tries).select((F.col("id") % n).cast("int").alias("family"), F.floor(F.col("id") / n).alias("attempt"))
    templates = F.array(*(F.lit(f.template) for f in families))
    text = F.get(templates, F.col("family"))
    for slot, values in SLOTS.items():
        text = F.replace(text, F.lit("{" + slot + "}"), pick(values, f"{seed}/{slot}", F.col("family"), F.col("attempt")))
    made = grid.withColumn("text", text)
    unique = made.groupBy("text").agg(F.min(F.struct("family", "attempt")).alias("x")).select("text", "x.family", "x.attempt")
    w = Window.partitionBy("family").orderBy("attempt")
    ranked = unique.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("family"))).where(F.col("_r") <= per_family)
    enough = F.when(F.col("_n") < per_family, F.raise_error(F.concat(F.lit("too few different texts in family "), F.col("family").cast("string"))).cast("int")).otherwise(F.col("family"))
    numbered = ranked.withColumn("family", enough).withColumn("_i", F.row_number().over(Window.orderBy(seeded(seed, F.col("text")), "text")))  # a benchmark is small
    return numbered.select(F.format_string(f"{prefix}-%04d", F.col("_i")).alias("id"), "text", "family")


def benchmark(spark: SparkSession, families: Sequence[Family] = FAMILIES, per_family: int = 20, seed: str = "20260329", prefix: str = "BENCH", tries: int = TRIES) -> DataFrame:
    """id, text, ground_truth, ground_truth_tr, difficulty, difficulty_tr, category, category_tr,
    label_rationale, source; names that no table has stand for themselves."""
    facts = spark.createDataFrame(
        [(i, f.label, LABEL_TR.get(f.label, f.label), f.difficulty, DIFFICULTY_TR.get(f.difficulty, f.difficulty), f.category, f.name or f.category, f.note, SOURCE) for i, f in enumerate(families)],
        "family int, ground_truth string, ground_truth_tr string, difficulty string, difficulty_tr string, category string, category_tr string, label_rationale string, source string",
    )
    return _rows(spark, families, per_family, seed, prefix, tries).join(F.broadcast(facts), "family").drop("family")


def phrasebank(spark: SparkSession, families: Sequence[Family] = PHRASES, per_family: int = 40, seed: str = "20260330", prefix: str = "PHRASE", tries: int = TRIES) -> DataFrame:
    """id, text, ground_truth, ground_truth_tr, category_id, category (its Turkish name), difficulty,
    surface_tone, hard_case, viewpoint, annotation_note."""
    facts = spark.createDataFrame(
        [(i, f.label, LABEL_TR.get(f.label, f.label), f.category, f.name or f.category, f.difficulty, f.tone or f.label, f.hard, f.viewpoint, f.note) for i, f in enumerate(families)],
        "family int, ground_truth string, ground_truth_tr string, category_id string, category string, difficulty string, surface_tone string, hard_case boolean, viewpoint string, annotation_note string",
    )
    return _rows(spark, families, per_family, seed, prefix, tries).join(F.broadcast(facts), "family").drop("family")


def rows_sql(families: Sequence[Family], per_family: int, seed: str, prefix: str, columns: dict[str, list], tries: int = TRIES) -> str:
    """The rows of a generator in SQL; columns: name -> value of each family."""
    q = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join([str(i), q(f.template), *(q(v[i]) for v in columns.values())]) + ")" for i, f in enumerate(families))
    text = "template"
    for slot, some in SLOTS.items():
        names = ", ".join(map(q, some))
        text = f"replace({text}, '{{{slot}}}', list_extract([{names}], 1 + (('0x' || substr(md5(concat_ws('|', '{seed}/{slot}', family, attempt)), 1, 8))::BIGINT % {len(some)})::INT))"
    cols = ", ".join(columns)
    return f"""WITH fam(family, template, {cols}) AS (VALUES {values}),
made AS (SELECT family, attempt, {text} AS text FROM fam, range({per_family * tries}) r(attempt)),
one AS (SELECT text, unnest(min({{'family': family, 'attempt': attempt}})) FROM made GROUP BY text),
few AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY family ORDER BY attempt) <= {per_family})
SELECT format('{prefix}-{{:04d}}', row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', text)), text)) AS id, text, {cols} FROM few JOIN fam USING (family)"""


def benchmark_sql(per_family: int = 20, seed: str = "20260329") -> str:
    f = FAMILIES
    return rows_sql(f, per_family, seed, "BENCH", {"ground_truth": [x.label for x in f], "ground_truth_tr": [LABEL_TR[x.label] for x in f], "difficulty": [x.difficulty for x in f], "difficulty_tr": [DIFFICULTY_TR[x.difficulty] for x in f], "category": [x.category for x in f], "category_tr": [x.name for x in f], "label_rationale": [x.note for x in f], "source": [SOURCE for _ in f]})


def phrasebank_sql(per_family: int = 40, seed: str = "20260330") -> str:
    f = PHRASES
    return rows_sql(f, per_family, seed, "PHRASE", {"ground_truth": [x.label for x in f], "ground_truth_tr": [LABEL_TR[x.label] for x in f], "category_id": [x.category for x in f], "category": [x.name for x in f], "difficulty": [x.difficulty for x in f], "surface_tone": [x.tone for x in f], "hard_case": [x.hard for x in f], "viewpoint": [x.viewpoint for x in f], "annotation_note": [x.note for x in f]})
