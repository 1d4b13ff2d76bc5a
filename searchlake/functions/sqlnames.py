"""The library's functions by name in SQL text: SQL functions, vectorised functions and a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from searchlake.functions import querylang as L
from searchlake.operators.spelling import sound_code
from searchlake.operators.understand import digits, written_operators

#: Functions that are one SQL expression over their argument; Catalyst puts it in their place.
EXPRESSIONS = {
    "crawl_key": ("url STRING", "STRING", r"lower(regexp_replace(regexp_replace(url, '#.*$', ''), '(.)/$', '$1'))"),
    "result_domain": ("url STRING", "STRING", r"if(contains(url, '://'), lower(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1)), '')"),
    "word_list": ("body STRING", "ARRAY<STRING>", r"filter(split(lower(body), '[^\\p{L}\\p{N}]+'), w -> w <> '')"),
    "snippet_of": ("body STRING", "STRING", "if(octet_length(body) > 500, left(body, 500), body)"),
}
VECTORISED = {"spoken_digits": digits, "written_operators": written_operators, "sound_code": sound_code}


class ExpandQuery:
    """expand_query(q, intent): the rows (pos, variant) of a query's expansion."""

    def eval(self, q: str, intent: str) -> Iterator[tuple[int, str]]:
        c = L.constraints(q or "")
        yield from enumerate(L.expansions(q or "", intent or "", c["negative"], c["references"]))


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to a session, as temporary functions; returns their names."""
    for name, (argument, kind, expression) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}({argument}) returns {kind} return {expression}")
    for name, made in VECTORISED.items():
        spark.udf.register(name, made)
    spark.udtf.register("expand_query", F.udtf(ExpandQuery, returnType="pos int, variant string"))
    return [*EXPRESSIONS, *VECTORISED, "expand_query"]
