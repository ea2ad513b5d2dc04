"""Localisation: which text of a record to translate, and a pluggable translator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

# Fields that may hold the text, in order of preference.
FIELDS = ("text", "content", "input", "original_text", "english_text", "sentence", "prompt")


def resolve_text(record: Column) -> Column:
    """The text of a JSON object: train.sentence, else the first string among FIELDS, else the
    first string of more than 10 characters at the top or one level below (in key order)."""
    v = F.try_parse_json(record)
    is_object = F.schema_of_variant(v).startswith("OBJECT")

    def string_at(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))

    first = F.coalesce(string_at("$.train.sentence"), *(string_at(f"$.{f}") for f in FIELDS))
    flat = F.from_json(record, "map<string,string>")
    values = F.map_values(flat)
    inner = F.transform(values, lambda x: F.when(F.trim(x).startswith("{"), F.get(F.filter(F.map_values(F.from_json(x, "map<string,string>")), lambda y: F.length(y) > 10), F.lit(0))).when(F.length(x) > 10, x))
    any_text = F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0))
    return F.when(is_object, F.coalesce(first, any_text))


def translate(df: DataFrame, text_col: str, translator: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """df with translated_text: what the translator returns for each batch, NULL where it fails."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "translated_text string"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            some = part[text_col].notna()
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            if some.any():
                try:
                    out[some] = translator(part.loc[some, text_col].tolist())
                except Exception:  # noqa: BLE001  a failed call leaves its rows untranslated
                    pass
            yield part.assign(translated_text=out)

    ship(df.sparkSession)
    return df.mapInPandas(run, schema)
