"""Query understanding over tables: staged functions run once per distinct text, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from searchlake.functions import querylang as L
from searchlake.functions.predicates import ENTITY_STOPS

SCHEMA = (
    "text string, positive array<string>, negative array<string>, entities array<struct<text:string,role:string>>, language string, file_types array<string>, sites array<string>, "
    "phrases array<string>, after_date string, before_date string, intitle array<string>, inurl array<string>, intext array<string>, related array<string>, price_min double, price_max double, "
    "compressed string"
)
_LISTS = ("positive", "negative", "file_types", "sites", "phrases", "intitle", "inurl", "intext", "related")
STOPS = frozenset(L.GENERIC | set(L.FILLERS) | set(L.DANGLING) | set(ENTITY_STOPS))
TECHNICAL = frozenset(L.CODE_WORDS) | frozenset(L.DOC_WORDS)


def _row(text: str | None) -> dict:
    c = L.constraints(text or "")
    roles = [(r, "reference") for r in c["references"]] + [(r, "comparison") for r in c["comparisons"]]
    named = {t for t, _ in roles}
    roles += [(n, "exclusion") for n in c["negative"] if n not in named] + [(p, "target") for p in c["positive"] if p not in named]
    kept = " ".join(w for w in (text or "").split() if w.strip(".,;").lower() not in c["negative"])
    return {"text": text, "entities": [{"text": t, "role": r} for t, r in roles], "compressed": L.compressed(kept or text or "", STOPS, TECHNICAL)} | {k: c[k] for k in (*_LISTS, "language", "after_date", "before_date", "price_min", "price_max")}


@F.pandas_udf(StringType())
def digits(texts: pd.Series) -> pd.Series:
    """Number words as digits."""
    return texts.map(L.spoken_to_digits, na_action="ignore")


@F.pandas_udf(StringType())
def written_operators(texts: pd.Series) -> pd.Series:
    """Spoken bounds and spaced operators in their written form."""
    return texts.map(L.canonical_operators, na_action="ignore")


@F.pandas_udf(StringType())
def compressed(texts: pd.Series) -> pd.Series:
    """Texts of over eight words by their most telling ones."""
    return texts.map(lambda t: L.compressed(t, STOPS, TECHNICAL), na_action="ignore")


def understand(queries: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct query text with its structured constraints and its compressed form."""
    fields = [f.split(" ", 1) for f in SCHEMA.split(", ")]
    entity = pa.list_(pa.struct([("text", pa.string()), ("role", pa.string())]))
    kinds = {"array<string>": pa.list_(pa.string()), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(n, entity if n == "entities" else kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_row(t) for t in batch.column(0).to_pylist()], schema=arrow)

    return queries.select(F.col(text).alias("text")).distinct().mapInArrow(run, SCHEMA)


def expand(queries: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    """(text, intent, pos, variant) of every distinct query."""
    schema = pa.schema([("text", pa.string()), ("intent", pa.string()), ("pos", pa.int32()), ("variant", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = L.constraints(t or "")
                rows += [{"text": t, "intent": i, "pos": k, "variant": v} for k, v in enumerate(L.expansions(t or "", i or "", c["negative"], c["references"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return queries.select(F.col(text).alias("text"), F.col(intent).alias("intent")).distinct().mapInArrow(run, "text string, intent string, pos int, variant string")


# fixed values: words that qualify a query without being its subject
MODIFIERS = ("best", "top", "good", "great", "latest", "new", "free", "cheap", "easy", "simple", "quick", "popular", "recommended", "ultimate", "complete")


def entities(text: Column) -> Column:
    """Stemmed subject words in order, without stop words and modifiers."""
    words = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: (w != "") & ~w.isin(*ENTITY_STOPS))
    stems = F.transform(words, lambda w: L.stem(w))
    return F.array_distinct(F.filter(stems, lambda w: ~w.isin(*MODIFIERS) & ~w.isin(*ENTITY_STOPS)))


def subsets(items: Column, cap: int = 8) -> Column:
    """Non-empty subsets of the first ``cap`` items as strings: larger ones first, then by name."""
    few = F.slice(items, 1, cap)

    def of(held: Column) -> Column:
        masks = F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2.0), F.size(held)).cast("int") - 1, F.lit(1)))
        chosen = F.transform(masks, lambda m: F.filter(held, lambda x, i: F.call_function("bit_get", m.cast("long"), i.cast("int")) == 1))
        keyed = F.transform(F.filter(chosen, lambda c: F.size(c) > 0), lambda c: F.struct((-F.size(c)).alias("n"), F.array_join(c, " ").alias("s")))
        return F.transform(F.array_sort(keyed), lambda k: k["s"])

    return F.get(F.transform(F.array(few), of), 0)
