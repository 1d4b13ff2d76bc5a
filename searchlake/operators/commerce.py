"""Offer comparison, affiliate links, goals: columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlake.functions import url as U
from searchlake.functions.dialect import ends_any, has_any, sql_any, sql_ends, sql_starts, starts_any
from searchlake.operators.sequences import numbered


def compare_offers(offers: DataFrame) -> DataFrame:
    """Products with two offers or more: the cheapest first, and whether they were seen at different times."""
    best = F.min(F.struct("price", "merchant")).alias("b")
    grouped = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_offers"), best, F.min("observed_at").alias("t0"), F.max("observed_at").alias("t1"))
    return grouped.where("n_offers >= 2").select("product_id", "n_offers", F.col("b.price").alias("best_price"), F.col("b.merchant").alias("best_merchant"), (F.col("t0") != F.col("t1")).alias("mixed_times"))


def match_programs(pages: DataFrame, programs: DataFrame) -> DataFrame:
    """page_id, url, program: of the enabled programs whose suffix is the host or one of its labels, the one of highest priority."""
    rows = pages.select("page_id", "url", U.bare_host(F.col("url")).alias("host"))
    keys = rows.select("page_id", F.explode(F.array_distinct(F.concat(F.array("host"), F.split("host", "[.]")))).alias("suffix"))
    known = programs.where("enabled").select(F.lower(F.regexp_replace("suffix", "[.]+$", "")).alias("suffix"), "program", "priority")
    # ties of priority go to the smaller name
    found = keys.join(known, "suffix").groupBy("page_id").agg(F.min(F.struct(-F.col("priority"), "program")).alias("m"))
    return rows.join(found, "page_id", "left").select("page_id", "url", F.col("m.program").alias("program"))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def affiliate_link(network: dict, url: Column, subid: Column, key: str = "", params: dict[str, str] | None = None) -> Column:
    """The destination in a network's template. Values that are not known are left out, every value is encoded once."""

    def fill(template: str, destination: Column) -> Column:
        out = F.lit(template)
        for token, value in (("{key}", F.lit(key)), ("{url}", destination), ("{subid}", subid)):
            out = F.replace(out, F.lit(token), value)
        for name, value in (params or {}).items():
            out = F.replace(out, F.lit(f"{{param:{name}}}"), F.lit(value))
        return F.regexp_replace(out, r"\{param:[^}]*\}", "")

    destination = percent_encoded(url) if network["kind"] == "wrap" else url
    base = fill(network["template"], destination)
    pairs = [(name, fill(value, destination)) for name, value in sorted(network.get("params", {}).items())]
    if network.get("bid_floor"):
        pairs.append(("bf", fill(network["bid_floor"], destination)))
    if network.get("fallback_url"):
        pairs.append(("fbu", F.lit(network["fallback_url"])))
    extra = F.concat_ws("&", *[F.when(v != "", F.concat(F.lit(f"{n}="), percent_encoded(v))) for n, v in pairs]) if pairs else F.lit("")
    return F.when(extra == "", base).when(F.contains(base, F.lit("?")), F.concat(base, F.lit("&"), extra)).otherwise(F.concat(base, F.lit("?"), extra))


# fixed values: weeks and phases of a timeline
TIMELINES = (("1 month", 4, 3), ("3 months", 12, 4), ("6 months", 24, 5), ("12 months", 48, 6))


def roadmap(goals: DataFrame, key: str, timeline: str, as_of: str) -> DataFrame:
    """A row per phase: duration and deadline, each with a week of buffer."""
    weeks, phases = F.lit(12), F.lit(4)
    for opening, w, p in TIMELINES:
        weeks = F.when(F.startswith(timeline, F.lit(opening)), w).otherwise(weeks)
        phases = F.when(F.startswith(timeline, F.lit(opening)), p).otherwise(phases)
    rows = goals.select(key, weeks.alias("w"), phases.alias("p")).select(key, F.explode(F.sequence(F.lit(1), F.col("p"))).alias("phase"), F.greatest(F.lit(1), F.floor(F.col("w") / F.col("p"))).cast("int").alias("duration_weeks"))
    end = F.date_add(F.lit(as_of).cast("date"), F.col("phase") * F.col("duration_weeks") * 7)
    text = F.concat(F.date_format(end, "yyyy-MM-dd"), F.lit(" (buffer: "), F.date_format(F.date_add(end, 7), "yyyy-MM-dd"), F.lit(")"))
    return rows.withColumn("deadline", text)


def _phases(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))


def goal_score() -> Column:
    """100 for a phase that is done, 500 more when all are."""
    return 100 * F.col("done") + F.when(F.col("done") == F.col("n"), 500).otherwise(0)


def goal_status(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey").join(_phases(lineitem), "o_orderkey", "left")
    status = F.when(F.col("n").isNull(), "pending_answers").when(F.col("done") == F.col("n"), "completed").otherwise("active")
    return rows.select("o_orderkey", status.alias("status"), F.coalesce(goal_score(), F.lit(0)).cast("long").alias("score"))


def leaderboard(orders: DataFrame, lineitem: DataFrame, top: int = 50) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey").join(_phases(lineitem), "o_orderkey")
    users = rows.groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum(goal_score()).cast("long").alias("score"), F.count_if(F.col("done") == F.col("n")).alias("completed"), F.max("o_orderkey").alias("newest"))
    return users.orderBy(F.desc("score"), F.desc("completed"), F.desc("newest")).limit(top)


def interleave(rows: DataFrame, group: str, order: list[Column], total: int, most: int) -> DataFrame:
    """Row i goes to phase i modulo ``total``; each phase takes its first ``most``."""
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).where(F.col("i") < total * most)
    return ranked.withColumn("phase", (F.col("i") % total).cast("int")).withColumn("pos", (F.floor(F.col("i") / total) + 1).cast("int"))


def goal_ids(goals: DataFrame) -> DataFrame:
    """Ids by order of arrival."""
    ids = F.format_string("goal_%04d", F.col("i") + 1)
    return numbered(goals, "first", ["goal"], "i").select(ids.alias("goal_id"), "first", F.lit("Anonymous").alias("user_name"))


# fixed values: keyword rules of the goal domains, in order of precedence
WRITE, WRITTEN = ("write", "draft", "author"), ("novel", "book", "story", "poem", "poetry", "script", "screenplay", "essay", "fiction", "memoir")
WRITING = ("novel", "screenplay", "scriptwriting", "fiction writing", "fantasy novel", "creative writing")
DRAW, DRAWN = ("design", "draw", "illustrate"), ("ui/ux", " ui ", "ux", "interface", "logo", "poster", "character")
DESIGN = ("ui/ux", "graphic design", "illustration", "3d model", "animation", "concept art")
RESEARCH = ("research", "thesis", "paper", "literature review", "dissertation", "academic")
ML_NAMES = ("machine learning", "deep learning", "reinforcement learning")
LEARNING = ("learn", "studying", "study", "mastering", "course", "tutorial", "certification")
BUSINESS = ("startup", "business", "saas", "e-commerce", "company", "venture", "monetize")
AI = ("ai ", "ml ", "machine learning", "deep learning", "reinforcement learning", "neural", "llm", "chatbot", "transformer", "nlp", "computer vision")
MOBILE = ("mobile", "ios", "android", "react native", "flutter", "app store")
WEB = ("website", "web app", "web platform", "frontend", "front-end", "full-stack", "fullstack")
BACKEND = ("api", "backend", "back-end", "microservice", "serverless", "graphql", "rest api")
SYSTEMS = ("system programming", "embedded", "kernel", "low-level", "driver", "firmware")
DEVOPS = ("devops", "ci/cd", "kubernetes", "infrastructure", "terraform", "deployment")
TECH = ("app", "software", "api", "platform", "system", "bot", "code", "develop", "build")
LIFESTYLE = ("cook", "cooking", "recipe", "bake", "baking", "garden", "gardening", "fitness", "workout", "guitar", "piano", "singing", "meditation", "yoga", "photography")
ART_WORD = r"(^|\s)(art|artwork)(\s|$)"
#: Sample goals beside the conversations, whose own words are invented.
GOALS = ("Write a fantasy novel", "Design a logo", "Research quantum machine learning", "Learn kubernetes", "Start a SaaS business", "Build a chatbot", "Make an android app", "Create a website", "Design a REST API backend", "Write embedded firmware", "Set up terraform", "Learn guitar", "Practice yoga", "Build some software")


def sub_domain(text: Column) -> Column:
    g = F.lower(text)
    any_ = lambda words: has_any(g, words)
    drawn = any_(DRAWN) | starts_any(g, ("ui ",)) | ends_any(g, (" ui",)) | F.rlike(g, F.lit(ART_WORD))
    return (
        F.when((any_(WRITE) & any_(WRITTEN)) | any_(WRITING), "creative-writing")
        .when((any_(DRAW) & drawn) | any_(DESIGN), "creative-design")
        .when(any_(RESEARCH), "research")
        .when(~any_(ML_NAMES) & any_(LEARNING), "learning")
        .when(any_(BUSINESS), "business")
        .when(any_(AI), "ai-ml")
        .when(any_(MOBILE), "mobile")
        .when(any_(WEB), "web-app")
        .when(any_(BACKEND), "api-backend")
        .when(any_(SYSTEMS), "systems")
        .when(any_(DEVOPS), "devops")
        .when(~any_(TECH) & any_(LIFESTYLE), "lifestyle")
        .when(any_(TECH), "general-tech")
        .otherwise("general")
    )


def sql_sub_domain(text: str) -> str:
    g = f"lower({text})"
    any_ = lambda words: sql_any(g, words)
    drawn = f"({any_(DRAWN)} or {sql_starts(g, ('ui ',))} or {sql_ends(g, (' ui',))} or regexp_matches({g}, '{ART_WORD}'))"
    return f"""case when ({any_(WRITE)} and {any_(WRITTEN)}) or {any_(WRITING)} then 'creative-writing' when ({any_(DRAW)} and {drawn}) or {any_(DESIGN)} then 'creative-design'
        when {any_(RESEARCH)} then 'research' when not {any_(ML_NAMES)} and {any_(LEARNING)} then 'learning' when {any_(BUSINESS)} then 'business' when {any_(AI)} then 'ai-ml'
        when {any_(MOBILE)} then 'mobile' when {any_(WEB)} then 'web-app' when {any_(BACKEND)} then 'api-backend' when {any_(SYSTEMS)} then 'systems' when {any_(DEVOPS)} then 'devops'
        when not {any_(TECH)} and {any_(LIFESTYLE)} then 'lifestyle' when {any_(TECH)} then 'general-tech' else 'general' end"""


# fixed values: language of a country
LANGUAGES = {
    "DE": "de", "AT": "de", "CH": "de", "FR": "fr", "BE": "fr", "CA": "fr", "ES": "es", "MX": "es", "AR": "es", "IT": "it", "PT": "pt", "BR": "pt", "NL": "nl",
    "RU": "ru", "JP": "ja", "CN": "zh", "TW": "zh", "KR": "ko", "KP": "ko", "SA": "ar", "AE": "ar", "EG": "ar", "TR": "tr", "PL": "pl", "SE": "da", "NO": "da",
    "DK": "da", "FI": "fi", "GR": "el", "CZ": "cs", "HU": "hu", "RO": "ro", "UA": "uk", "IL": "he", "TH": "th", "VN": "vi", "ID": "id", "MY": "ms", "PH": "tl",
}


def language_tag(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(table, country), F.lit("en")), F.lit("-"), country)


def sql_language_tag(country: str) -> str:
    return "(case " + f"{country} " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + f" else 'en' end) || '-' || {country}"


def located(queries: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Place and where it comes from: named in the query, a local wish, the address, or nothing."""
    named = queries.select(key, F.explode(F.split("text", r"\s+")).alias("name")).join(places, "name", "left_semi").groupBy(key).agg(F.min("name").alias("named"))
    rows = queries.join(named, key, "left")
    local = F.contains("text", F.lit("near me"))
    place = F.when(F.col("named").isNotNull(), F.col("named")).when(local, "New York").when(F.col("has_ip"), F.col("n_name"))
    source = F.when(F.col("named").isNotNull(), "explicit").when(local, "local_intent_fallback").when(F.col("has_ip"), "ip").otherwise("none")
    return rows.select(key, place.alias("place"), source.alias("source"))


def range_lookup(rows: DataFrame, key: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Left join on ``low <= key <= high`` through buckets of ``width``, so that the join is on equal keys."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    on = (F.floor(F.col(key) / width) == F.col("_b")) & F.col(key).between(F.col(low), F.col(high))
    return rows.join(cut, on, "left").drop("_b")
