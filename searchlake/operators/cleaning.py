"""Snippet cleaning, structured-data prices and naming questions.

Nested braces are no regular language: the two brace scanners and the JSON walk run in Arrow batches. All else is column
functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from searchlake.functions import text as T
from searchlake.functions.dialect import has_any

# fixed values: boilerplate patterns, in order
BOILERPLATE = (
    r"(?i)toggle the table of contents[^\n]{0,700}",
    r"(?i)your browser doesn't support html5 audio[^\n]*",
    r"(?i)[/\[]\s*[\p{L}\p{M}.ˈˌ: ]{2,}\s*[/\]]\s*(uk|us)?",
    r"(?i)photograph:[^\n]*?(view image in fullscreen|view image|getty images?|via [a-z]+|/ap|\b(ap|reuters|pa media|epa|afp)\b)",
    r"(?i)view image in fullscreen",
    r"(?i)\b(sign up (now|today|free|here)|subscribe (now|today|to (our|the))|our (daily|weekly|free) newsletter|\w+ daily newsletter|get the \w+ newsletter)[^\n]*",
    r"(?i)image credit:[^\n]*",
    r"(?i)[A-Z][\w.'-]+(, [A-Z][\w.'-]+)*\s*\(\s*\d{1,2}\s+\w+\s+\d{4}\s*\)\.\s+[\"“]",
    r"(?i)retrieved\s+\d{1,2}\s+\w+\s+\d{4}[^\n]*",
    r"(?i)jump to:[^\n]*",
    r"(?i)\b(read more|see also|cookie policy|accept cookies|we use cookies)[^\n]*",
    r"(?i)\badvertisement\b",
    r"(?i)just an example of the laughs we have here[.]?",
    r"(?i)posts from this topic will be added to your daily email digest[^\n]*",
    r"(?i)follow follow see all[^\n]*",
    r"(?i)report close report[^\n]*",
    r"(?i)(video item preview|in-browser video [“”]?theater[“”]? requires javascript|this item does not appear to have any files)[^\n]*",
)
# fixed values: what tells style sheets from text
AT_WORDS = ("@font-face", "@media", "@import", "@charset", "@keyframes")
STYLE_MARKS = ("@media", "@font", "@import", "@keyframes", "@charset", "!important", "url(", "iframe")


def block_end(text: str, start: int, plain: bool = False) -> int:
    """Place after the brace block that opens at ``start``; -1 if it never closes. Strings, comments and parentheses hide braces unless ``plain``."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if not plain and text.startswith("/*", i):
            close = text.find("*/", i + 2)
            i = len(text) if close < 0 else close + 2
            continue
        if not plain and c == '"':
            i += 1
            while i < len(text) and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
        elif not plain and c == "(":
            level = 1
            while level and i + 1 < len(text):
                i += 1
                level += (text[i] == "(") - (text[i] == ")")
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def without_structured_data(text: str) -> str:
    """Drops every brace block with an ``@context`` or ``@type`` key, also inside quotes and cut off at the end; keeps its neighbours."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        stop = block_end(text, start, plain=True)
        whole = text[start:] if stop < 0 else text[start:stop]
        out.append(text[at:start])
        if "@context" not in whole and "@type" not in whole:
            out.append(whole)
        at = len(text) if stop < 0 else stop
    return "".join(out) + text[at:]


def is_style(block: str) -> bool:
    """Looks like a style rule: a mark or a property, and no sentence in it."""
    if any(end in block for end in (". ", "? ", "! ")):
        return False
    low = block.lower()
    return any(m in low for m in STYLE_MARKS) or re.search(r"[^\W\d_]:(?!/)", block) is not None


def without_styles(text: str) -> str:
    """Drops brace blocks that are style rules."""
    out, at = "", 0
    while (start := text.find("{", at)) >= 0:
        stop = block_end(text, start)
        out += text[at:start]
        if stop < 0:
            return out + text[start:]
        if not is_style(text[start:stop]):
            out += text[start:stop]
        elif not out.endswith(" ") and text[stop : stop + 1] not in ("", " "):
            out += " "
        at = stop
    return out + text[at:]


@F.pandas_udf(StringType())
def unbraced(texts: pd.Series) -> pd.Series:
    """Both scanners; texts without a brace pass untouched."""
    return texts.map(lambda t: without_styles(without_structured_data(t)) if t and "{" in t else t)


def title_echo(content: Column, title: Column) -> Column:
    """Without a leading part of the title of 15 characters or more, and one separator after it; nothing if that is all."""
    c, t = F.ltrim(content), F.trim(title)
    low_c, low_t = (F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for x in (c, t))
    size = F.least(F.length(c), F.length(t))
    # the prefix is found by halving: a longer one matches only if all shorter ones do
    low, high = F.lit(0), size

    def shared(held: Column) -> Column:
        start = F.struct(low.alias("lo"), held.alias("hi"))
        step = lambda a, _: F.transform(F.array(F.floor((a["lo"] + a["hi"] + 1) / 2).cast("int")), lambda m: F.when(low_c.substr(F.lit(1), m) == low_t.substr(F.lit(1), m), F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), (m - 1).alias("hi"))))[0]
        return F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, lambda a, x: F.when(a["lo"] < a["hi"], step(a, x)).otherwise(a), lambda a: a["lo"])

    n = F.get(F.transform(F.array(high), shared), 0)
    rest = F.ltrim(F.regexp_replace(F.ltrim(c.substr(n + 1, F.length(c))), "^[-|:–— ]", ""))
    return F.when(n < 15, content).when(n >= F.length(c), "").otherwise(rest)


def clean(rows: DataFrame, raw: str, title: str, out: str = "content") -> DataFrame:
    """The whole chain: scripts, structured data, styles, tags, entities, boilerplate, blanks, title echo, last sentence.

    Three projections, as the scanners are Python and the title echo is a higher-order function.
    """
    s = F.regexp_replace(F.regexp_replace(raw, r"(?is)<style[^>]*>.*?</style>", " "), r"(?is)<script[^>]*>.*?</script>", " ")
    rows = rows.withColumn(out, unbraced(s))
    s = F.regexp_replace(F.regexp_replace(out, r"(?s)\{[^{}]*\{[^{}]*\}[^{}]*\}", " "), r"(?s)\{[^{}]*\}", " ")
    s = F.regexp_replace(s, r"(?i)url\(\s*['\"]?[^\"')]*['\"]?\s*\)", " ")
    for word in AT_WORDS:
        s = F.regexp_replace(s, f"(?i){word}", " ")
    s = T.decoded(F.regexp_replace(s, r"(?s)<[^>]+>", " "))
    for pattern in BOILERPLATE:
        s = F.regexp_replace(s, pattern, " ")
    rows = rows.withColumn(out, F.trim(F.regexp_replace(s, r"[\n\r\t ]+", " ")))
    rows = rows.withColumn(out, title_echo(F.col(out), F.col(title)))
    return rows.withColumn(out, T.bounded(F.col(out)))


def _amount(value) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    try:
        return float(str(value).strip().replace(",", "")) if isinstance(value, str) else None
    except ValueError:
        return None


def price_in(data) -> tuple[float, str] | None:
    """The first price of a structured-data tree, outside in, with the currency given beside it."""
    if isinstance(data, list):
        return next((p for p in map(price_in, data) if p), None)
    if not isinstance(data, dict):
        return None
    amount = _amount(data["price"] if "price" in data else data.get("lowPrice"))
    if amount is not None:
        code = data["priceCurrency"] if "priceCurrency" in data else data.get("currency")
        return amount, code if isinstance(code, str) else "USD"
    return next((p for p in map(price_in, data.values()) if p), None)


_BLOCK = re.compile(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")
_PRICE_TAG = re.compile(r"(?is)<([a-z]+)[^>]*itemprop=[\"']price[\"'][^>]*>([^<]*)")
_CODE_TAG = re.compile(r"(?is)<([a-z]+)[^>]*itemprop=[\"']priceCurrency[\"'][^>]*>([^<]*)")
_CONTENT = re.compile(r"(?is)content=[\"']([^\"']*)[\"']")


def page_price(html: str) -> tuple[float, str] | None:
    """Price and raw currency of a page, from structured data, else from item properties; never from prose."""
    for block in _BLOCK.findall(html):
        try:
            found = price_in(json.loads(block))
        except ValueError:
            continue
        if found:
            return found

    def given(tag: re.Pattern) -> str | None:
        hit = tag.search(html)
        inside = hit and _CONTENT.search(hit.group())
        return inside.group(1) if inside else hit.group(2) if hit else None

    amount = _amount(given(_PRICE_TAG)) if _PRICE_TAG.search(html) else None
    return None if amount is None else (amount, given(_CODE_TAG) or "USD")


def page_prices(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, price, currency) of pages that state one; pages without any mark never reach Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *p) for k, h in zip(frame[key], frame["html"]) if (p := page_price(h))]
            yield pd.DataFrame(found, columns=[key, "price", "raw"])

    marked = pages.select(F.col(key), F.col(html).alias("html")).where(F.rlike("html", F.lit(r"(?i)ld\+json|itemprop")))
    kind = pages.schema[key].dataType.simpleString()
    return marked.mapInPandas(run, f"{key} {kind}, price double, raw string").select(key, "price", T.currency(F.col("raw")).alias("currency"))


# fixed values: closed vocabulary of naming questions
NAMING = ("named", "called", "name", "names", "naming", "nickname", "nicknamed", "etymology")
ASKING = r"^(why|how|where|what|who|when)\b"


def naming_question(text: Column) -> Column:
    q = F.lower(text)
    return F.rlike(q, F.lit(ASKING)) & F.rlike(q, F.lit(r"\b(named|called|nicknamed|etymology)\b|\bname\b.*\b(come|came|origin)|\b(get|got)\b.*\bname\b"))


def question_title(title: Column) -> Column:
    return F.endswith(F.trim(title), F.lit("?")) | F.rlike(F.lower(title), F.lit(ASKING))


def naming_score(question: Column, title: Column, score: Column) -> Column:
    """Pages that only pose the question stay below the top of the scale; pages that answer it keep their score."""
    return F.when(naming_question(question) & question_title(title), F.least(score * 0.5, F.lit(0.49))).otherwise(score)


# fixed values: words that a goal's topic leaves out, and short ones that it keeps
TOPIC_STOPS = ("the", "and", "for", "with", "your", "that", "this", "from", "into", "build", "make", "create", "learn", "write", "start")
SHORT = ("ai", "ml", "go", "c", "r", "ui", "ux", "io", "ar", "vr")


def phase_titles(goals: DataFrame, goal: str = "goal", phases: int = 4) -> DataFrame:
    """A title and two objectives per phase, from the goal's own words."""
    words = F.filter(F.split(F.lower(goal), r"[^\p{L}\p{N}]+"), lambda w: ((F.length(w) >= 3) | w.isin(*SHORT)) & ~w.isin(*TOPIC_STOPS))
    # fixed values: wording of the titles and objectives
    topic = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col(goal))
    rows = goals.withColumn("topic", topic).withColumn("phase", F.explode(F.sequence(F.lit(1), F.lit(phases))))
    short = T.truncated(F.col(goal), 85)
    title = F.when(F.col("phase") == 1, F.concat(F.lit("Phase 1: Plan & Begin '"), short, F.lit("'"))).when(F.col("phase") == phases, F.concat(F.lit(f"Phase {phases}: Finish & Review '"), short, F.lit("'")))
    title = title.otherwise(F.concat(F.lit("Phase "), F.col("phase").cast("string"), F.lit(": Build '"), short, F.lit("'")))
    kind = F.when(F.col("phase") == 1, "foundation").when(F.col("phase") == phases, "completion").otherwise("progress")
    objectives = F.array(F.concat(F.lit("Define the scope and success criteria for '"), "topic", F.lit("'.")), F.concat(F.lit("Set up the foundation before building '"), "topic", F.lit("'.")))
    return rows.select(goal, "phase", title.alias("title"), kind.alias("kind"), F.array_join(objectives, " ").alias("objectives"))
