"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a pattern over host and path. Its whole literal tokens (runs of letters and digits with
separators on both sides in the pattern) are counted over all URLs, and the rule is filed under the
rarest. A URL's own tokens fetch the candidate rules; only those run their regular expressions. The index is
an array of hash buckets in the projection, as large as the rule list: there is no shuffle and no join.

Of the host/path rules that fit (host and its subdomains, start of the path) the longest wins; where none does,
the longest fitting pattern decides, and without one a URL is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed. Every
row is kept, also repeated ones; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base rules, as (host, path, verdict)
BASE = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Pattern rules over host and path: ``^`` is a separator or the start, ``*`` any run.
PATTERNS = (
    ("^ads-track.", "block"),
    ("^casino-win.", "block"),
    ("^cheap-pills.", "block"),
    ("^spam-farm.", "block"),
    ("^adserver.", "block"),
    ("^doubleclick.", "block"),
    ("^popunder.", "block"),
    ("/banner/", "block"),
    ("/sponsored/", "block"),
    ("/affiliate/*^click^", "block"),
    ("^casino*/login/", "block"),
    ("^ads-track.*/policy/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A compiled rule. ``tokens`` are those that every matching URL holds."""

    text: str
    verdict: str
    base: bool
    regex: str
    tokens: tuple[str, ...]


def compile_base(host: str, path: str, verdict: str) -> Rule:
    tokens = [t for t in re.split("[^0-9a-z]+", host.lower()) if t]
    # the path may go on after its last letter, so only tokens that end before its end are whole
    tokens += [t for t in re.split("[^0-9a-z]+", re.sub("[0-9A-Za-z]+$", "", path).translate(str.maketrans(_UPPER, _LOWER))) if t]
    return Rule(host + path, verdict, True, f"^([^/]*[.])?{_quote(host)}{_quote(path)}", tuple(dict.fromkeys(tokens)))


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-" else f"[{c}]" if c not in "^\\[]" else "\\" + c for c in text)


def compile_pattern(pattern: str, verdict: str) -> Rule:
    regex = "".join("(^|[^0-9a-z])" if c == "^" else ".*" if c == "*" else _quote(c) for c in pattern)
    tokens = re.findall(r"(?<![0-9a-z*])(?<=.)[0-9a-z]+(?=[^0-9a-z*])", pattern)
    if not tokens:
        raise ValueError(f"{pattern}: a rule needs a whole literal token")
    return Rule(pattern, verdict, False, f"(?s){regex}", tuple(dict.fromkeys(tokens)))


def default_rules() -> list[Rule]:
    return [compile_base(*b) for b in BASE] + [compile_pattern(*p) for p in PATTERNS]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, text.substr(at + F.lit(3), F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, "[^0-9a-z]+"), lambda t: t != ""))


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[list[list[dict]], list[str]]:
    """Hash buckets of (token, rules), and the token each rule is filed under."""
    chosen = [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules]
    size = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for token in dict.fromkeys(chosen):
        buckets[zlib.crc32(token.encode()) % size].append({"t": token, "r": [i for i, c in enumerate(chosen) if c == token]})
    return buckets, chosen


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the deciding pattern, for every row."""
    rules = default_rules() if rules is None else rules
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path")).withColumn("lower_key", F.translate("key", _UPPER, _LOWER))
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = rows.select(F.explode(F.filter(url_tokens(F.col("lower_key")), lambda t: t.isin(wanted))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["t"]: r["n"] for r in seen.collect()}  # one number for each token of the rules
    buckets, _ = _index(rules, counts)
    index = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t:string,r:array<int>>>>")
    table = F.from_json(
        F.lit(json.dumps([{"text": r.text, "verdict": r.verdict, "base": r.base, "regex": r.regex, "size": len(r.text)} for r in rules])),
        "array<struct<text:string,verdict:string,base:boolean,regex:string,size:int>>",
    )
    fetched = F.transform(
        url_tokens(F.col("lower_key")),
        lambda t: F.flatten(F.transform(F.filter(F.get(index, (F.crc32(t.cast("binary")) % len(buckets)).cast("int")), lambda e: e["t"] == t), lambda e: e["r"])),
    )
    rows = rows.withColumn("candidates", F.transform(F.array_distinct(F.flatten(fetched)), lambda i: F.get(table, i)))
    fits = F.filter("candidates", lambda c: F.when(c["base"], F.rlike(F.col("key"), c["regex"])).otherwise(F.rlike(F.col("lower_key"), c["regex"])))
    rows = rows.withColumn("fits", fits)

    def longest(base: bool) -> Column:
        kept = F.filter("fits", lambda c: c["base"] == F.lit(base))
        return F.array_max(F.transform(kept, lambda c: F.struct(c["size"].alias("size"), c["text"].alias("text"), c["verdict"].alias("verdict"))))

    rows = rows.withColumn("b", longest(True)).withColumn("p", longest(False))
    return rows.select(
        "page_id", "host", "path", F.col("b.text").alias("rule"), F.coalesce(F.col("b.verdict"), F.col("p.verdict"), F.lit("allow")).alias("verdict"),
        F.col("p.text").alias("pattern"),
    )


def oracle(rules: list[Rule] | None = None, table: str = "pages") -> str:
    """DuckDB SQL for :func:`judge_urls`: every rule runs on every URL."""
    rules = default_rules() if rules is None else rules
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def best(base: bool, field: str) -> str:
        mine = sorted((r for r in rules if r.base == base), key=lambda r: (len(r.text), r.text, r.verdict), reverse=True)
        key = "key" if base else "lower_key"
        return "case " + " ".join(f"when regexp_matches({key}, {q(r.regex)}) then {q(getattr(r, field))}" for r in mine) + " end"

    return f"""
with t as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from {table}),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from t),
k as (select *, host || path as key, translate(host || path, '{_UPPER}', '{_LOWER}') as lower_key from h)
select page_id, host, path, {best(True, "text")} as rule, coalesce({best(True, "verdict")}, {best(False, "verdict")}, 'allow') as verdict, {best(False, "text")} as pattern
from k
"""
