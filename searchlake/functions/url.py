"""URL columns: identity, host, kind, refresh interval, authority, reserved hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlake.functions.dialect import ends_any, has_any, sql_any, sql_ends, sql_starts, starts_any

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"

# fixed values: path and host signals of the content types, in order of precedence
NEWS_PATHS = ("/news/", "/article/", "/press/", "/blog/", "/story/", "/breaking/", "/report/", "/headline/")
NEWS_HOSTS = ("news.", "blog.", "press.", "media.")
DOC_PATHS = ("/docs/", "/doc/", "/api/", "/reference/", "/documentation/", "/manual/", "/guide/", "/tutorial/", "/handbook/", "/wiki/")
MORE_DOC_PATHS = ("/learn/", "/examples/", "/getting-started/")
DOC_HOSTS = ("docs.", "doc.", "developer.", "dev.", "learn.", "api.", "reference.", "manual.", "wiki.")
HELP_HOSTS = ("help.", "support.")
FORUM_PATHS = ("/forum/", "/thread/", "/discussion/", "/q/", "/question/", "/topic/", "/post/", "/comment/", "/reply/", "/ask/", "/community/", "/board/")
PRODUCT_PATHS = ("/product/", "/p/", "/item/", "/store/", "/shop/", "/pricing", "/buy/", "/purchase/", "/cart/")
ARTICLE_PATHS = ("/article/", "/essay/", "/write-up/", "/publication/", "/paper/", "/research/")
# fixed values: seconds between visits
REFRESH = {"news": 3600, "documentation": 86400, "homepage": 43200, "forum": 7200, "product": 21600, "article": 14400, "unknown": 14400}
# fixed values: signals of a domain's authority
SPAM_MARKS = ("content-farm", "clickbait", "top10best", "bestof", "listicle", "buzzfeed")
UGC_PATHS = ("/thread/", "/question/", "/post/", "/comment/", "/discussion/", "/q/")
# fixed values: time-sensitive paths
NEWS_MARKS = ("/news/", "/world/", "/politics/", "/sport/", "/business/", "/election", "news.", "/world-cup")
# fixed values: hosts whose short snippets count
ACADEMIC_HOSTS = ("arxiv.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "semanticscholar.org", "doi.org", "bibsonomy.org", "researchgate.net", "aclanthology.org", "openreview.net", "ieeexplore.ieee.org", "dl.acm.org", "link.springer.com", "sci-hub.se", "sci-hub.st")
ACADEMIC_SUFFIXES = (".arxiv.org", ".ncbi.nlm.nih.gov", ".semanticscholar.org", ".aclanthology.org", ".sci-hub.se", ".sci-hub.st")
# fixed values: names that no real host has
RESERVED = ("example", "test", "invalid", "localhost")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "invidious", "m.youtube.com")
_ARCHIVE = r"(?i)^https?://web\.archive\.org/web/[0-9]+(?:[a-z_]*id_?)?/"


def parsed_host(url: Column) -> Column:
    """Host of an absolute URL in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(url, SCHEME + "(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed_path(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + "[^/?#]*([^?#]*)", 1)


def sql_parsed_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '{SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def sql_parsed_path(url: str) -> str:
    return f"regexp_extract({url}, '{SCHEME}[^/?#]*([^?#]*)', 1)"


def percent_decoded(text: Column) -> Column:
    """%XX decoding that keeps plus signs; null when the bytes are not UTF-8."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def unwrapped(url: Column, depth: int = 3) -> Column:
    """The URL inside web-archive wrappers, plain or percent-encoded, up to ``depth`` of them."""
    for _ in range(depth):
        plain = F.regexp_extract(url, _ARCHIVE + "(https?://.*)", 1)
        coded = F.regexp_extract(url, _ARCHIVE + "(https?%3a%2f%2f.*)", 1)
        url = F.when(plain != "", plain).when(coded != "", F.coalesce(percent_decoded(coded), url)).otherwise(url)
    return url


def canonical(url: Column) -> Column:
    """Host and path in lower case without a trailing slash: the identity of a result."""
    inner = unwrapped(url)
    joined = F.concat(parsed_host(inner), F.regexp_replace(F.lower(parsed_path(inner)), "/+$", ""))
    return F.when(parsed_host(inner) != "", joined).otherwise(F.lower(inner))


def sql_canonical(url: str, depth: int = 3) -> str:
    inner = url
    for _ in range(depth):
        a, b = f"regexp_extract({inner}, '{_ARCHIVE}(https?://.*)', 1)", f"regexp_extract({inner}, '{_ARCHIVE}(https?%3a%2f%2f.*)', 1)"
        inner = f"(case when {a} <> '' then {a} when {b} <> '' then url_decode({b}) else {inner} end)"
    return (
        f"case when {sql_parsed_host(inner)} <> '' then {sql_parsed_host(inner)} || regexp_replace(lower({sql_parsed_path(inner)}), '/+$', '') else lower({inner}) end"
    )


def crawl_key(url: Column) -> Column:
    """The crawler's identity: no fragment, no trailing slash, lower case; scheme and query stay."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(.)/$", "$1"))


def sql_crawl_key(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({url}, '#.*$', ''), '(.)/$', '\\1'))"


def bare_host(value: Column) -> Column:
    """Host of a URL or of a bare authority: no user info, numeric port or trailing dot."""
    rest = F.regexp_replace(value, "^.*?://", "")
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.regexp_replace(host, "[.]+$", ""))


def sql_bare_host(value: str) -> str:
    rest = f"regexp_replace({value}, '^.*?://', '')"
    authority = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    return f"lower(regexp_replace(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''))"


def diversity_domain(url: Column) -> Column:
    """What results are limited by: between ``://`` and ``/``, before ``:``."""
    return F.lower(F.regexp_extract(url, "^.*?://([^/:]*)", 1))


def sql_diversity_domain(url: str) -> str:
    return f"lower(regexp_extract({url}, '^.*?://([^/:]*)', 1))"


def content_type(url: Column) -> Column:
    low, host, path = F.lower(url), parsed_host(url), parsed_path(url)
    return (
        F.when(has_any(low, NEWS_PATHS) | starts_any(host, NEWS_HOSTS), "news")
        .when(has_any(low, DOC_PATHS + MORE_DOC_PATHS) | starts_any(host, DOC_HOSTS), "documentation")
        .when(has_any(low, FORUM_PATHS), "forum")
        .when(has_any(low, PRODUCT_PATHS), "product")
        .when(has_any(low, ARTICLE_PATHS), "article")
        .when((host != "") & path.isin("", "/"), "homepage")
        .otherwise("unknown")
    )


def sql_content_type(url: str) -> str:
    low, host = f"lower({url})", sql_parsed_host(url)
    return f"""case when {sql_any(low, NEWS_PATHS)} or {sql_starts(host, NEWS_HOSTS)} then 'news'
        when {sql_any(low, DOC_PATHS + MORE_DOC_PATHS)} or {sql_starts(host, DOC_HOSTS)} then 'documentation'
        when {sql_any(low, FORUM_PATHS)} then 'forum' when {sql_any(low, PRODUCT_PATHS)} then 'product' when {sql_any(low, ARTICLE_PATHS)} then 'article'
        when {host} <> '' and {sql_parsed_path(url)} in ('', '/') then 'homepage' else 'unknown' end"""


def refresh_seconds(kind: Column) -> Column:
    found = F.lit(None)
    for name, seconds in REFRESH.items():
        found = F.when(kind == name, seconds).otherwise(found)
    return found.cast("long")


def sql_refresh_seconds(kind: str) -> str:
    return "cast(case " + " ".join(f"when {kind} = '{k}' then {v}" for k, v in REFRESH.items()) + " end as bigint)"


def authority(url: Column) -> Column:
    """Trust of a domain from the shape of its URL, 0 to 1."""
    low, host = F.lower(url), parsed_host(url)
    segments = F.filter(F.split(F.lower(parsed_path(url)), "/"), lambda s: s != "")
    labels = F.size(F.split(host, "[.]"))
    first, second = F.get(segments, 0), F.get(segments, 1)
    repo = F.coalesce((F.octet_length(first) >= 2) & (F.octet_length(second) >= 2) & ~F.contains(first, F.lit(".")) & ~F.contains(second, F.lit(".")), F.lit(False))
    versioned = F.exists(segments, lambda s: F.rlike(s, F.lit(r"^v[\p{N}.]+$")))
    params = F.length(F.regexp_replace(F.regexp_extract(low, r"^[^?]*[?]([^?]*)", 1), "[^&]", ""))
    add = lambda when, value: F.when(when, value).otherwise(0.0)
    score = (
        F.lit(0.5)
        + F.when(ends_any(host, (".edu", ".gov", ".ac.uk")), 0.3).when(ends_any(host, (".org", ".net")), 0.1).when(F.rlike(host, F.lit(r"[.]\p{L}{2}$")), 0.05).otherwise(0.0)
        + add(starts_any(host, DOC_HOSTS + HELP_HOSTS), 0.25)
        + add(has_any(low, DOC_PATHS), 0.2)
        + add(repo, 0.1)
        + add(versioned, 0.1)
        + F.when(labels == 2, 0.1).when(labels >= 5, -0.1).otherwise(0.0)
        + add(params > 5, -0.1)
        + add(has_any(low, SPAM_MARKS), -0.2)
        + add(has_any(low, UGC_PATHS), 0.05)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def sql_authority(url: str) -> str:
    low, host = f"lower({url})", sql_parsed_host(url)
    segments = f"list_filter(string_split(lower({sql_parsed_path(url)}), '/'), lambda s: s <> '')"
    return f"""least(greatest(0.5::double
        + (case when {sql_ends(host, (".edu", ".gov", ".ac.uk"))} then 0.3 when {sql_ends(host, (".org", ".net"))} then 0.1 when regexp_matches({host}, '[.]\\p{{L}}{{2}}$') then 0.05 else 0 end)::double
        + (case when {sql_starts(host, DOC_HOSTS + HELP_HOSTS)} then 0.25 else 0 end)::double + (case when {sql_any(low, DOC_PATHS)} then 0.2 else 0 end)::double
        + (case when strlen({segments}[1]) >= 2 and strlen({segments}[2]) >= 2 and not contains({segments}[1], '.') and not contains({segments}[2], '.') then 0.1 else 0 end)::double
        + (case when len(list_filter({segments}, lambda s: regexp_matches(s, '^v[\\p{{N}}.]+$'))) > 0 then 0.1 else 0 end)::double
        + (case when len(string_split({host}, '.')) = 2 then 0.1 when len(string_split({host}, '.')) >= 5 then -0.1 else 0 end)::double
        + (case when length(regexp_replace(regexp_extract({low}, '^[^?]*[?]([^?]*)', 1), '[^&]', '', 'g')) > 5 then -0.1 else 0 end)::double
        + (case when {sql_any(low, SPAM_MARKS)} then -0.2 else 0 end)::double + (case when {sql_any(low, UGC_PATHS)} then 0.05 else 0 end)::double, 0), 1)"""


def news_path(url: Column) -> Column:
    return has_any(F.lower(url), NEWS_MARKS)


def academic(url: Column) -> Column:
    host = parsed_host(url)
    return host.isin(*ACADEMIC_HOSTS) | ends_any(host, ACADEMIC_SUFFIXES)


def sql_academic(url: str) -> str:
    host = sql_parsed_host(url)
    return f"({host} in ({', '.join(repr(h) for h in ACADEMIC_HOSTS)}) or {sql_ends(host, ACADEMIC_SUFFIXES)})"


def reserved_host(host: Column) -> Column:
    """A label is reserved by name, or starts with ``example`` and a separator."""
    labels = F.split(F.lower(F.regexp_replace(F.trim(host), "[.]+$", "")), "[.]")
    return F.exists(labels, lambda x: x.isin(*RESERVED) | F.rlike(x, F.lit("^example[^0-9a-z]")))


def sql_reserved_host(host: str) -> str:
    labels = f"string_split(lower(regexp_replace(trim({host}), '[.]+$', '')), '.')"
    return f"(len(list_filter({labels}, lambda x: x in ('example', 'test', 'invalid', 'localhost') or regexp_matches(x, '^example[^0-9a-z]'))) > 0)"


def placeholder_url(url: Column) -> Column:
    """As for hosts, with ``-`` or ``_`` as the separator; what has no host is a placeholder too."""
    labels = F.split(F.regexp_replace(parsed_host(url), "[.]+$", ""), "[.]")
    return (parsed_host(url) == "") | F.exists(labels, lambda x: x.isin(*RESERVED) | F.rlike(x, F.lit("^example[-_]")))


# fixed values: marks of the resource kinds, in order of precedence
RESOURCE_MARKS = (
    ("repository", ("github.com", "gitlab.com", "bitbucket.org")),
    ("course", ("codecademy.com", "coursera.org", "udemy.com", "leetcode.com", "edx.org")),
    ("video", ("youtube.com", "youtu.be", "vimeo.com")),
    ("documentation", ("/docs/", "/doc/", "/api/", "/reference/", "/wiki/", "/manual/", "developer.mozilla.org")),
    ("paper", ("arxiv.org", "researchgate.net", "acm.org", "ieee.org", "semantic-scholar.org")),
)


def resource_kind(url: Column) -> Column:
    found = F.lit("article")
    for kind, marks in reversed(RESOURCE_MARKS):
        found = F.when(has_any(url, marks), kind).otherwise(found)
    return found


def sql_resource_kind(url: str) -> str:
    return "case " + " ".join(f"when {sql_any(url, marks)} then '{kind}'" for kind, marks in RESOURCE_MARKS) + " else 'article' end"


def video_host(url: Column) -> Column:
    host = parsed_host(url)
    return has_any(host, VIDEO_HOSTS)


def url_parts(url: Column) -> Column:
    """scheme, authority, path, query and fragment of a reference; null where it has none (a path may be empty)."""
    def part(pattern: str) -> Column:
        return F.when(F.rlike(url, F.lit(pattern)), F.regexp_extract(url, pattern, 1))

    scheme = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
    return F.struct(
        part("^([a-zA-Z][a-zA-Z0-9+.-]*):").alias("scheme"), part(f"{scheme}//([^/?#]*)").alias("authority"), F.regexp_extract(url, f"{scheme}(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        part(r"^[^?#]*\?([^#]*)").alias("query"), part("(?s)#(.*)$").alias("fragment"),
    )


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; paths that don't begin with a slash stay."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
        lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
    )
    end = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.rlike(path, F.lit(r"^/(.*/)?\.\.?(/|$)")), F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))).otherwise(path)


def resolved(base: Column, ref: Column) -> Column:
    """The reference with parts ``ref`` against an absolute base with parts ``base``, by the rules of RFC 3986, scheme and authority in lower case; null without a base scheme."""
    merged = F.when(base["authority"].isNotNull() & (base["path"] == ""), F.concat(F.lit("/"), ref["path"])).otherwise(F.concat(F.regexp_extract(base["path"], "(?s)^(.*/)?", 1), ref["path"]))
    own = ref["scheme"].isNotNull() | ref["authority"].isNotNull()
    path = F.when(own | F.startswith(ref["path"], F.lit("/")), without_dots(ref["path"])).when(ref["path"] == "", base["path"]).otherwise(without_dots(merged))
    query = F.when(~own & (ref["path"] == "") & ref["query"].isNull(), base["query"]).otherwise(ref["query"])
    authority = F.when(own, ref["authority"]).otherwise(base["authority"])
    optional = lambda mark, value: F.coalesce(F.concat(F.lit(mark), value), F.lit(""))
    return F.concat(F.lower(F.coalesce(ref["scheme"], base["scheme"])), F.lit(":"), optional("//", F.lower(authority)), path, optional("?", query), optional("#", ref["fragment"]))
