"""Text columns: extraction from HTML, entropy and quality, fingerprints, dates, currencies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from searchlake.functions.dialect import has_any, sql_any

# fixed values: entity replacements, in order
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#x27;", "'"), ("&#x2F;", "/"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"))


def decoded(text: Column) -> Column:
    for old, new in ENTITIES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sql_decoded(text: str) -> str:
    for old, new in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, old, new.replace("'", "''"))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sql_collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def untagged(html: Column) -> Column:
    """Text nodes joined by blanks, white space collapsed."""
    return collapsed(decoded(F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "(?s)<[^>]+>", " ")))


def sql_untagged(html: str) -> str:
    return sql_collapsed(sql_decoded(f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"))


def page_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.rlike(html, F.lit(r"(?i)<title[^>]*>")), decoded(found)).otherwise("No Title")


def sql_page_title(html: str) -> str:
    return f"case when regexp_matches({html}, '(?i)<title[^>]*>') then {sql_decoded(f'regexp_extract({html}, {chr(39)}(?is)<title[^>]*>(.*?)</title>{chr(39)}, 1)')} else 'No Title' end"


def sql_page_texts(html: str, tag: str) -> str:
    """The inside of the first element of a name, up to its end tag or the end of the page."""
    return f"regexp_extract({html}, '(?is)<{tag}[^>]*>(.*?)(?:</{tag}>|$)', 1)"


def sql_page_decoded(text: str) -> str:
    """The entities of the pages; a reference decodes once, so ampersands come last."""
    for old, new in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{old}', '{new}')"
    return text


def sql_main_text(html: str, cap: int = 6500) -> str:
    """For pages without other selectors: of main, article and body the first with over 500 bytes, else the last that is there."""
    out = "''"
    for tag in ("body", "article", "main"):
        inner = sql_collapsed(sql_page_decoded(f"regexp_replace(regexp_replace({sql_page_texts(html, tag)}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"))
        there = f"regexp_matches({html}, '(?i)<{tag}[ >]')"
        rest = out if tag != "body" else f"case when {there} then {inner} else '' end"
        out = f"case when {there} and strlen({inner}) > 500 then {inner} else {rest} end"
    return f"left({out}, {cap})"


def sql_text_nodes(inside: str) -> str:
    """Text nodes joined by blanks, white space as it is."""
    return sql_page_decoded(f"regexp_replace(regexp_replace({inside}, '(?s)^(<[^>]*>)+|(<[^>]*>)+$', '', 'g'), '(?s)(<[^>]*>)+', ' ', 'g')")


def sql_one_shot(html: str) -> str:
    """For pages with article and body only: the article if it has over 200 bytes, else the body, at most 5000 characters."""
    article, body = (sql_text_nodes(sql_page_texts(html, tag)) for tag in ("article", "body"))
    return f"left(trim(case when strlen({article}) > 200 then {article} else {body} end, ' ' || chr(9) || chr(10) || chr(13)), 5000)"


_MEASURES = StructType([StructField("entropy", DoubleType()), *(StructField(n, LongType()) for n in ("letters", "solid", "words"))])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which bytes are white space."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000), np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def _measured(text: str) -> tuple[float | None, int, int, int]:
    letter, blank = _tables()
    head = np.frombuffer(text[:2000].encode("ascii", "ignore"), dtype=np.uint8)
    bits = None
    if len(head):
        counts = np.bincount(head)
        shares = counts[counts > 0] / len(head)
        bits = float(-(shares * np.log2(shares)).sum()) + 0.0
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    points = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gap = blank[data]
    return bits, int(letter[points].sum()), int((~gap).sum()), int((~gap & np.append(True, gap[:-1])[: len(gap)]).sum())


@F.pandas_udf(_MEASURES)
def _measures(texts: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if t is None else _measured(t) for t in texts]
    return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype="Float64" if n == "entropy" else "Int64") for k, n in enumerate(("entropy", "letters", "solid", "words"))})


def measures(text: Column) -> Column:
    """What quality is judged by, in one pass: entropy (Shannon, in bits, of the ASCII characters among the first 2000; null without
    any), letters, solid (bytes that are no white space) and words of a text. Counting characters has no built-in function, and
    one replacement per distinct character costs some milliseconds a text.
    """
    return _measures(text)


def entropy(text: Column) -> Column:
    return measures(text)["entropy"]


def sql_entropy(text: str) -> str:
    chars = f"regexp_replace(left({text}, 2000), '[^\\x00-\\x7F]', '', 'g')"
    count = f"(length({chars}) - length(replace({chars}, c, '')))::double / length({chars})"
    return f"case when length({chars}) > 0 then -list_sum(list_transform(list_sort(list_distinct(string_split({chars}, ''))), lambda c: ({count}) * log2({count}))) end"


def alpha_ratio(text: Column, m: Column) -> Column:
    """Letters by bytes; ``m`` are the text's measures."""
    return m["letters"].cast("double") / F.greatest(F.octet_length(text), F.lit(1))


def sql_alpha_ratio(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))::double / greatest(strlen({text}), 1)"


def quality_from(text: Column, m: Column) -> Column:
    """Content quality of a text with the measures ``m``."""
    h, words, mean = m["entropy"], m["words"], m["solid"].cast("double") / m["words"]
    score = (
        F.when(h < 2.0, 0.2).when(h < 3.0, 0.5).when(h > 6.5, 0.3).otherwise(1.0)
        * F.when(alpha_ratio(text, m) < 0.4, 0.4).otherwise(1.0)
        * F.when(words == 0, 1.0).when(mean > 20, 0.2).when(mean > 15, 0.5).otherwise(1.0)
    )
    score = score + F.least(F.octet_length(text) / 5000.0, F.lit(1.0)) * 0.1
    return F.when(F.octet_length(text) < 100, 0.2).when(h.isNull(), 0.1).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def sql_quality_from(text: str, h: str) -> str:
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"
    mean = f"(strlen(regexp_replace({text}, '\\s', '', 'g'))::double / len({words}))"
    return f"""case when strlen({text}) < 100 then 0.2::double when {h} is null then 0.1::double else least(greatest(
        (case when {h} < 2 then 0.2 when {h} < 3 then 0.5 when {h} > 6.5 then 0.3 else 1 end)::double * (case when {sql_alpha_ratio(text)} < 0.4 then 0.4 else 1 end)::double
        * (case when len({words}) = 0 then 1 when {mean} > 20 then 0.2 when {mean} > 15 then 0.5 else 1 end)::double + least(strlen({text}) / 5000.0::double, 1) * 0.1::double, 0), 1) end"""


def indexworthy(title: Column, content: Column, m: Column) -> Column:
    """Whether a page with the measures ``m`` of its content goes into the index."""
    return (F.octet_length(title) >= 5) & (title != "No Title") & (F.octet_length(content) >= 200) & F.coalesce(m["entropy"].between(2.5, 6.5), F.lit(False)) & (alpha_ratio(content, m) >= 0.3)


def sql_indexworthy(title: str, content: str, h: str) -> str:
    return f"(strlen({title}) >= 5 and {title} <> 'No Title' and strlen({content}) >= 200 and coalesce({h} between 2.5 and 6.5, false) and {sql_alpha_ratio(content)} >= 0.3)"


def bounded(text: Column) -> Column:
    """Cut after the last sentence end; unchanged without one."""
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    return F.when(cut != "", cut).otherwise(text)


def sql_bounded(text: str) -> str:
    cut = f"regexp_extract({text}, '(?s)^(.*[.!?])', 1)"
    return f"case when {cut} <> '' then {cut} else {text} end"


def fingerprint(title: Column, content: Column) -> Column:
    plain = lambda x, n: F.left(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""), F.lit(n))
    return F.concat(plain(title, 60), F.lit("|"), plain(content, 180))


def sql_fingerprint(title: str, content: str) -> str:
    plain = lambda x, n: f"left(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), {n})"
    return f"{plain(title, 60)} || '|' || {plain(content, 180)}"


def truncated(text: Column, most: int) -> Column:
    """Cut at a blank within ``most`` characters, with three dots; shorter texts stay."""
    head = F.left(text, F.lit(most))
    whole = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.octet_length(text) <= most, text).when(F.rlike(head, F.lit(r"\s")), F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def sql_truncated(text: str, most: int) -> str:
    head = f"left({text}, {most})"
    return f"""case when strlen({text}) <= {most} then {text} when regexp_matches({head}, '\\s') then regexp_replace(regexp_extract({head}, '(?s)^(.*)\\s', 1), '\\s+$', '') || '...' else {head} || '...' end"""


def points(text: Column) -> Column:
    """The first four parts between line breaks, full stops and semicolons."""
    parts = F.filter(F.transform(F.split(F.trim(text), "[\n.;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text) == "", F.array(F.lit("Define objectives for this phase based on your goal."))).when(F.size(parts) == 0, F.array(F.trim(text))).otherwise(F.slice(parts, 1, 4))


def sql_points(text: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(trim({text}), '[\\n.;]'), lambda x: trim(x)), lambda x: x <> '')"
    return f"case when trim({text}) = '' then ['Define objectives for this phase based on your goal.'] when len({parts}) = 0 then [trim({text})] else ({parts})[1:4] end"


def snippet(text: Column) -> Column:
    return F.when(F.octet_length(text) > 500, F.left(text, F.lit(500))).otherwise(text)


def rough_epoch(date: Column) -> Column:
    """Seconds by 365-day years and 30-day months, from the first ten characters ``Y-M-D``; null outside 2000 to 2030."""
    parts = F.split(F.left(F.trim(date), F.lit(10)), "-")
    y, m, d = (F.expr("1").cast("int") * 0 + F.try_to_number(F.get(parts, i), F.lit("9999")).cast("int") for i in range(3))
    ok = (F.size(parts) == 3) & y.between(2000, 2030) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, ((y - 1970).cast("long") * 365 + (m - 1) * 30 + d) * 86400)


def publication(dates: Column, url: Column) -> Column:
    """Rough seconds of the first date that is one: of the given marks in their order, else of the first place of each pattern in the url."""
    at = []
    for pattern in (r"/(\d{4})/(\d{2})/(\d{2})/", r"/(\d{4})/(\d{2})/()", r"(\d{4})-(\d{2})-(\d{2})"):
        y, m, d = (F.regexp_extract(F.lower(url), pattern, i) for i in (1, 2, 3))
        at.append(F.concat(y, F.lit("-"), m, F.lit("-"), F.when(d == "", "01").otherwise(d)))
    found = F.filter(F.transform(F.concat(dates, F.array(*at)), rough_epoch), lambda t: t.isNotNull())
    return F.get(found, 0)


def exact_epoch(date: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.left(F.trim(date), F.lit(10)), F.lit("yyyy-MM-dd")))


# fixed values: currency words, in order of precedence
CURRENCIES = (
    (("$", "usd", "dollar"), "USD"),
    (("€", "eur", "euro"), "EUR"),
    (("£", "gbp", "pound"), "GBP"),
    (("₹", "inr", "rupee", "rs"), "INR"),
    (("¥", "jpy", "yen"), "JPY"),
)


def currency(text: Column) -> Column:
    low, found = F.lower(F.trim(text)), F.lit("USD")
    for words, code in reversed(CURRENCIES):
        hit = F.lit(code) if code != "USD" else F.when(has_any(low, ("can", "cad")), "CAD").when(has_any(low, ("au", "aud")), "AUD").otherwise("USD")
        found = F.when(has_any(low, words), hit).otherwise(found)
    return found


def sql_currency(text: str) -> str:
    low = f"lower(trim({text}))"
    return "case " + " ".join(
        f"when {sql_any(low, words)} then " + (f"'{code}'" if code != "USD" else f"(case when {sql_any(low, ('can', 'cad'))} then 'CAD' when {sql_any(low, ('au', 'aud'))} then 'AUD' else 'USD' end)")
        for words, code in CURRENCIES
    ) + " else 'USD' end"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sql_words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
