"""The label dictionary and the expressions that read and write label text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base label (German) and its English name, in id order.
BASE_LABELS = [
    ("No Tag", "No Tag"),
    ("Obscure", "Obscure"),
    ("Abteilung", "Department"),
    ("Aktivität", "Performance/Activity"),
    ("Akzente", "Accents"),
    ("Anlass", "Occasion"),
    ("Besonderheiten", "Features"),
    ("Charakter", "Character"),
    ("Charakter Familie", "Character Family"),
    ("Dämpfungsgrad", "Cushioning Level"),
    ("Erscheinungsjahr", "Release Year"),
    ("EU-Schuhgröße", "EU Shoe Size"),
    ("Farbe", "Color"),
    ("Futtermaterial", "Lining Material"),
    ("Gewebeart", "Fabric Type"),
    ("Herstellernummer", "Style Code"),
    ("Herstellungsland und -region", "Country/Region of Manufacture"),
    ("Innensohlenmaterial", "Insole Material"),
    ("Jahreszeit", "Season"),
    ("Laufsohlenmaterial", "Outsole Material"),
    ("Marke", "Brand"),
    ("Maßeinheit", "Unit of Measure"),
    ("Modell", "Model"),
    ("Muster", "Pattern"),
    ("Obermaterial", "Upper Material"),
    ("Produktart", "Type"),
    ("Produktlinie", "Product Line"),
    ("Schuhschaft-Typ", "Shoe Shaft Style"),
    ("Schuhweite", "Shoe Width"),
    ("Stil", "Style"),
    ("Stollentyp", "Cleat Type"),
    ("Thema", "Theme"),
    ("UK-Schuhgröße", "UK Shoe Size"),
    ("US-Schuhgröße", "US Shoe Size"),
    ("Verschluss", "Closure"),
    ("Zwischensohlen-Typ", "Midsole Type"),
]
# Labels that never form a span, and the continuation suffix.
SKIPPED = ("No Tag", "Obscure")
INNER_SUFFIX = "-I"
# The tags reported per fold.
TAGS_OF_INTEREST = (
    "No Tag", "Modell", "Produktart", "Marke", "Farbe",
    "Abteilung", "Produktlinie", "Stil", "Herstellernummer", "EU-Schuhgröße",
)

N_BASE = len(BASE_LABELS)
INNER_OFFSET = N_BASE - len(SKIPPED)
N_LABELS = N_BASE + INNER_OFFSET
FIRST_ASPECT_ID = len(SKIPPED)

DIM_SCHEMA = "label_id int, label string, base string, is_inner boolean, english string"


def label_rows() -> list[tuple]:
    """All 70 labels: the base labels, then one inner label per aspect."""
    base = [(i, name, name, False, english) for i, (name, english) in enumerate(BASE_LABELS)]
    inner = [
        (i + INNER_OFFSET, name + INNER_SUFFIX, name, True, None)
        for i, name, _, _, _ in base[FIRST_ASPECT_ID:]
    ]
    return base + inner


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), DIM_SCHEMA)


def is_inner(label: Column) -> Column:
    return label.endswith(INNER_SUFFIX)


def strip_inner(label: Column) -> Column:
    return F.regexp_replace(label, INNER_SUFFIX + "$", "")


def is_skipped(label: Column) -> Column:
    return label.isin(*SKIPPED)


def as_inner(label: Column) -> Column:
    """Label of a word that continues `label`; skipped labels have no inner form."""
    return F.when(is_skipped(label), label).otherwise(F.concat(label, F.lit(INNER_SUFFIX)))
