"""Query understanding: column expressions for the regular parts, plain functions for the staged ones.

The plain functions (spoken numbers, operator rewriting, constraints, compression, expansion) are staged and
stateful; :mod:`searchlake.operators.understand` runs them in Arrow batches over distinct query texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.functions.dialect import has_any, quoted, sql_any, sql_list, starts_any

# fixed values: number words
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), start=2)}
SCALES = {"hundred": 100, "thousand": 1000}
# fixed values: units of time, before which a number is no price
TIME_UNITS = ("years", "year", "months", "month", "weeks", "week", "days", "day", "hours", "hour", "minutes", "minute")
# fixed values: spoken forms of the operators
UPPER_FORMS = ("under", r"less\s+than", "below", r"cheaper\s+than", "max(?:imum)?")
LOWER_FORMS = ("over", r"more\s+than", "above", r"greater\s+than", "min(?:imum)?")
SPACED = ((r"in\s+url\s*:\s*|inurl\s+", "inurl:"), (r"on\s+site\s*:\s*|onsite\s+", "site:"), (r"in\s+title\s*:\s*|intitle\s+", "intitle:"), (r"in\s+text\s*:\s*|intext\s+", "intext:"))
OPERATORS = ("site", "filetype", "intitle", "inurl", "intext", "related", "price", "lang", "after", "before")
# fixed values: negation markers and what they never exclude
NEGATIONS = ("not", "nor", "without", "except", "excluding", "minus", "besides", "no", "other than")
NO_COMPOUNDS = ("sql", "code", "loss", "ops", "block")
# fixed values: words too general to be a topic or an exclusion
GENERIC = frozenset(
    "how what why when where who which that this these those the a an and or but use using require required requires need needed needs do does did can could would should "
    "will with without from into onto upon over under before after than them they their our your its his her not no".split()
)
# fixed values: markers of references and comparisons
REFERENCES = ("alternative to", "alternatives to", "similar to", "comparable to", "replacement for", "substitute for", "competitor of", "competitors of")
COMPARISONS = ("better than", "faster than", "cheaper than", "lighter than", "easier than", "simpler than", "more performant than", "more efficient than")
# fixed values: filler words, and words that may not stand at an end
FILLERS = ("how", "to", "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might", "shall")
DANGLING = ("a", "an", "the", "to", "for", "in", "on", "of", "and", "or", "with", "from", "by", "under", "over", "about", "into", "than", "as", "at", "but", "nor", "so", "vs", "versus", "up", "off", "out", "per", "via", "onto", "upon")
# fixed values: regions after "in"
REGIONS = (
    "us", "usa", "united states", "uk", "united kingdom", "england", "scotland", "canada", "australia", "india", "germany", "france", "spain", "italy", "japan", "china", "brazil",
    "mexico", "russia", "korea", "europe", "asia", "africa", "latin america", "south america", "north america", "eu", "singapore", "indonesia", "philippines", "vietnam", "thailand",
    "netherlands", "ireland", "sweden", "norway", "denmark", "finland", "poland", "portugal",
)
# fixed values: words that speak for a language, and those that decide
SIGNATURES = {
    "fr": ("de", "la", "le", "les", "des", "et", "recette", "gateau", "pour", "dans", "une", "que", "qui", "est", "avec"),
    "de": ("der", "die", "das", "und", "ist", "rezept", "kuchen", "fur", "mit", "wie", "man", "lernt", "ein", "eine", "nicht"),
    "es": ("el", "la", "los", "las", "y", "en", "para", "con", "mejor", "zapatos", "baratos", "comprar", "que", "uno", "una", "por"),
    "nl": ("van", "het", "een", "en", "koptelefoon", "voor", "de", "die", "met", "is", "op"),
}
MARKERS = {
    "fr": ("recette", "gateau", "pour", "dans", "une"),
    "de": ("wie", "man", "lernt", "rezept", "kuchen", "fur"),
    "es": ("mejor", "zapatos", "baratos", "comprar", "para"),
    "nl": ("koptelefoon", "voor", "van"),
}
# fixed values: exotic punctuation
PUNCTUATION = (("：", ":"), ("，", ", "), ("、", ", "), ("｜", " | "), ("－", "-"), ("—", " - "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("　", " "))
LOCALE_TAG = r"(?i)\b[a-z]{2}[_-][a-z]{2}\b"

#: Sample queries that make the rules fire; the conversation table's own words are invented.
SAMPLES = (
    'find "solid state drive" reviews site:reddit.com', "boots under four hundred dollars filetype:pdf", "python web frameworks without django or flask", "how how to to set up set up redis",
    "recette gateau pour une fete", "laptop price:200-900 lang:en", "react vs vue", "latest rust releases", "who is ada lovelace", "tell me a joke", "what is dark matter", "alternative to notion",
    "cheap phones in germany en-US", "kubernetes ingress tls configuration", "intitle:guide after:2024-01-01 before:2024-06-01 -site:pinterest.com", "over five years of data inurl github",
)
def sql_with_samples(rows: str, samples: tuple[str, ...]) -> str:
    """All rows (conv_id, turn, text) and each sample once, under negative ids."""
    return f"{rows} union all select * from (values " + ", ".join(f"({-1 - i}, 0, {quoted(t)})" for i, t in enumerate(samples)) + ") as s(conv_id, turn, text)"


def with_samples(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    more = rows.sparkSession.createDataFrame([(-1 - i, 0, t) for i, t in enumerate(samples)], rows.schema)
    return rows.unionByName(more)


def phrases(text: Column) -> Column:
    plain = F.translate(text, "“”‘’", '""""')
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit('"([^"]*)"'), 1), lambda p: F.trim(p)), lambda p: p != "")


def without_phrases(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.translate(text, "“”‘’", '""""'), '"[^"]*"', ""), F.lit('"'), F.lit(""))


def sql_phrases(text: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(translate({text}, '“”‘’', '\"\"\"\"'), '"([^"]*)"', 1), lambda p: trim(p)), lambda p: p <> '')"""


def sql_without_phrases(text: str) -> str:
    return f"""replace(regexp_replace(translate({text}, '“”‘’', '\"\"\"\"'), '"[^"]*"', '', 'g'), '"', '')"""


def price_low(value: Column) -> Column:
    """Lower bound of a price operator's value: ``>N``, or the first of ``a-b``."""
    clean = F.regexp_replace(value, "[^0-9.-]", "")
    return F.when(F.rlike(clean, F.lit("^[0-9.]*-[0-9.]*$")), F.try_to_number(F.split(clean, "-")[0], F.lit("999999999.99"))).when(F.startswith(F.ltrim(value), F.lit(">")), F.try_to_number(clean, F.lit("999999999.99"))).cast("double")


def price_high(value: Column) -> Column:
    clean = F.regexp_replace(value, "[^0-9.-]", "")
    return F.when(F.rlike(clean, F.lit("^[0-9.]*-[0-9.]*$")), F.try_to_number(F.split(clean, "-")[1], F.lit("999999999.99"))).when(~F.startswith(F.ltrim(value), F.lit(">")), F.try_to_number(clean, F.lit("999999999.99"))).cast("double")


def operator_values(text: Column, name: str, negated: bool = False) -> Column:
    sign = "-" if negated else "(?:^|[^-a-z])"
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"{sign}{name}:(\S*)"), 1), lambda v: v != "")


def sql_operator_values(text: str, name: str, negated: bool = False) -> str:
    sign = "-" if negated else "(?:^|[^-a-z])"
    return f"list_filter(regexp_extract_all(lower({text}), '{sign}{name}:(\\S*)', 1), lambda v: v <> '')"


def _one_of(words):
    return lambda w: w.isin(*words)


def language(text: Column) -> Column:
    """French, German, Spanish or Dutch when their words clearly win, else null."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    count = {k: F.size(F.filter(words, _one_of(v))) for k, v in SIGNATURES.items()}
    hits = {k: F.exists(words, _one_of(v)) for k, v in MARKERS.items()}
    top = F.greatest(*count.values())
    # of equal counts the last in order wins
    best = F.when(count["nl"] == top, "nl").when(count["es"] == top, "es").when(count["de"] == top, "de").otherwise("fr")
    any_hit = hits["fr"] | hits["de"] | hits["es"] | hits["nl"]
    chosen = F.when(hits["fr"], "fr").when(hits["de"], "de").when(hits["es"], "es").when(hits["nl"], "nl").otherwise(best)
    return F.when((top >= 2) & ((top * 2 > F.size(words)) | any_hit), chosen)


def sql_language(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')"
    count = {k: f"len(list_filter({words}, lambda w: w in {sql_list(v)}))" for k, v in SIGNATURES.items()}
    hit = {k: f"len(list_filter({words}, lambda w: w in {sql_list(v)})) > 0" for k, v in MARKERS.items()}
    top = f"greatest({', '.join(count.values())})"
    best = f"case when {count['nl']} = {top} then 'nl' when {count['es']} = {top} then 'es' when {count['de']} = {top} then 'de' else 'fr' end"
    chosen = "case " + " ".join(f"when {hit[k]} then '{k}'" for k in hit) + f" else {best} end"
    return f"case when {top} >= 2 and ({top} * 2 > len({words}) or {' or '.join(hit.values())}) then {chosen} end"


def tidied(text: Column) -> Column:
    for old, new in PUNCTUATION:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, LOCALE_TAG, " ")


def sql_tidied(text: str) -> str:
    for old, new in PUNCTUATION:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return f"regexp_replace({text}, '{LOCALE_TAG}', ' ', 'g')"


IN_REGION = r"(?i)\bin\s+([a-z][a-z\s]*?)\s*$"


def region(text: Column) -> Column:
    found = F.lower(F.trim(F.regexp_extract(text, IN_REGION, 1)))
    return F.when(found.isin(*REGIONS), found)


def destuttered(text: Column) -> Column:
    """Without adjacent repeats of a word, then of a pair, then later repeats of filler words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.lower(w))
    single = F.filter(words, lambda w, i: (i == 0) | (F.get(low, i - 1) != F.lower(w)))
    pairs = F.transform(F.array(single), lambda s: F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), _start(), lambda a, i: _pair_step(s, a, i), lambda a: a["out"]))
    held = F.get(pairs, 0)
    unique = F.transform(F.array(held), lambda h: F.filter(h, lambda w, i: ~F.lower(w).isin(*FILLERS) | (F.array_position(F.transform(h, lambda x: F.lower(x)), F.lower(w)) == i + 1)))
    return F.array_join(F.get(unique, 0), " ")


def _start() -> Column:
    return F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))


def _pair_step(s: Column, a: Column, i: Column) -> Column:
    low = lambda k: F.lower(F.get(s, k))
    twice = F.coalesce((low(i) == low(i + 2)) & (low(i + 1) == low(i + 3)), F.lit(False))
    taken = F.when(a["skip"] > 0, F.array().cast("array<string>")).when(twice, F.array(F.get(s, i), F.get(s, i + 1))).otherwise(F.array(F.get(s, i)))
    skip = F.when(a["skip"] > 0, a["skip"] - 1).when(twice, 3).otherwise(0)
    kept = F.filter(taken, lambda w: w.isNotNull())
    return F.struct(skip.cast("int").alias("skip"), F.concat(a["out"], kept).alias("out"))


def sanitised(text: Column) -> Column:
    """Adjacent repeats collapse, function words fall off both ends."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    single = F.filter(words, lambda w, i: (i == 0) | (F.lower(F.get(words, i - 1)) != F.lower(w)))
    ends = "|".join(DANGLING)
    return F.regexp_replace(F.regexp_replace(F.array_join(single, " "), rf"(?i)^(?:(?:{ends})(?:\s+|$))+", ""), rf"(?i)(?:(?:^|\s+)(?:{ends}))+$", "")


def sql_sanitised(text: str) -> str:
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"
    single = f"list_filter({words}, lambda w, i: i = 1 or lower(({words})[i - 1]) <> lower(w))"
    ends = "|".join(DANGLING)
    return f"regexp_replace(regexp_replace(array_to_string({single}, ' '), '(?i)^(?:(?:{ends})(?:\\s+|$))+', ''), '(?i)(?:(?:^|\\s+)(?:{ends}))+$', '')"


# fixed values: markers of the intents
THAN = tuple(f" {w} than " for w in ("better", "worse", "faster", "slower", "cheaper", "more reliable", "more durable", "lighter", "heavier", "bigger", "smaller", "stronger", "weaker", "safer", "quieter", "louder", "cooler", "hotter"))
CHITCHAT = (
    "how are you", "how r you", "how you doing", "how's it going", "hows it going", "tell me a joke", "tell me joke", "a joke", "who are you", "who r you", "what are you", "are you real",
    "are you human", "good morning", "good evening", "good afternoon", "good night", "thank you", "thanks", "hey", "hi there", "hello there", "what's up", "whats up", "nice to meet you",
    "can you help", "make me laugh", "sing a song", "what is your name", "whats your name", "meaning of life", "purpose of life", "why are we here", "why do we exist", "what is the meaning", "point of life",
)
GREETINGS = ("hi", "hello", "hey", "yo", "sup", "thanks", "thank you")
RECENT = ("latest", "recent", "newest", "this week", "this month", "past week", "past month", "last week", "last month", "today", "2026 news", "2025 news", "new release", "new version", "current", "upcoming", "news 202", "releases 202")
NO_TOPIC = ("latest", "recent", "newest", "today", "this", "week", "month", "past", "last", "current", "new", "upcoming", "the", "for", "and", "with")
DOC_WORDS = (
    "docs", "doc", "api", "reference", "configure", "configuration", "config", "tls", "ssl", "setup", "install", "tutorial", "guide", "explained", "example", "examples", "implementation",
    "architecture", "spec", "specification", "cli", "sdk", "library", "framework", "syntax", "async", "event loop", "ingress", "handler", "middleware", "deployment", "pooling", "module",
    "pattern", "patterns", "cluster", "index", "query", "schema", "migration", "cache", "benchmark", "benchmarking", "networking", "connection", "authentication", "authorization", "routing",
    "logging", "metrics", "pipeline", "state", "thread", "process", "memory", "build", "compile", "debug", "test", "testing", "deploy", "scale", "scaling",
)
CODE_WORDS = (
    "kubernetes", "docker", "nginx", "postgresql", "postgres", "redis", "terraform", "kafka", "rabbitmq", "graphql", "grpc", "rust", "python", "golang", "typescript", "javascript", "react",
    "vue", "node", "nodejs", "elasticsearch", "mongodb", "mysql", "sqlite", "cassandra", "prometheus", "grafana", "etcd", "consul", "vault", "aws", "gcp", "azure", "linux", "windows",
    "macos", "kotlin", "swift", "java", "scala", "ruby", "php", "django", "flask", "fastapi", "spring", "express", "rails",
)


def with_intent(rows: DataFrame, text: str, label: str = "intent", confidence: str = "confidence") -> DataFrame:
    """Label and confidence after the ordered lexical overrides; each is a projection, as it reads what the one before wrote."""
    rows = rows.withColumn("_q", F.lower(text)).withColumn("_w", F.filter(F.split("_q", r"\s+"), lambda w: w != ""))
    q, words, now = F.col("_q"), F.col("_w"), F.col(label)
    starts = lambda *openings: starts_any(q, openings)
    versus = has_any(q, (" vs ", " versus ", " or ")) | F.rlike(q, F.lit("^(vs|versus) "))
    how = has_any(q, ("how to", "how do i ", "how do you ", "how can i ", "steps to ", "tutorial for ")) | starts("how do")
    clear = has_any(q, ("how to", "steps to ")) | starts("how do")
    recent = has_any(q, RECENT)
    topic = F.exists(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*NO_TOPIC))
    coded = F.exists(words, lambda w: w.isin(*CODE_WORDS) | F.regexp_replace(w, "s+$", "").isin(*CODE_WORDS))
    rules = (
        (versus & (now != "comparison"), F.lit("comparison"), 0.9),
        (has_any(q, THAN) & (now != "comparison"), F.lit("comparison"), 0.9),
        (how & ((now == "how-to") | clear), F.lit("how-to"), 0.6),
        ((has_any(q, CHITCHAT) | F.trim(q).isin(*GREETINGS)) & (now != "chitchat"), F.lit("chitchat"), 0.7),
        (recent & topic & (now != "fresh"), F.lit("fresh"), 0.7),
        ((now == "fresh") & ~recent & starts("how ", "why ", "what causes"), F.when(starts("how "), "how-to").otherwise("informational"), 0.6),
        (coded & (has_any(q, DOC_WORDS) | (F.size(words) >= 2)) & (now != "technical"), F.lit("technical"), 0.6),
    )
    for change, name, floor in rules:
        rows = rows.withColumn("_c", change)
        rows = rows.withColumns({confidence: F.when(F.col("_c"), F.greatest(F.col(confidence), F.lit(floor))).otherwise(F.col(confidence)), label: F.when(F.col("_c"), name).otherwise(now)})
    return rows.drop("_q", "_w", "_c")


def sql_intent(table: str) -> str:
    """Staged common table expressions from ``table(id columns, q, label, conf)`` to ``intents``."""
    words = "list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')"
    stages = [
        (f"({sql_any('q', (' vs ', ' versus ', ' or '))} or regexp_matches(q, '^(vs|versus) ')) and label <> 'comparison'", "'comparison'", 0.9),
        (f"{sql_any('q', THAN)} and label <> 'comparison'", "'comparison'", 0.9),
        (f"({sql_any('q', ('how to', 'how do i ', 'how do you ', 'how can i ', 'steps to ', 'tutorial for '))} or starts_with(q, 'how do')) and (label = 'how-to' or contains(q, 'how to') or starts_with(q, 'how do') or contains(q, 'steps to '))", "'how-to'", 0.6),
        (f"({sql_any('q', CHITCHAT)} or trim(q) in {sql_list(GREETINGS)}) and label <> 'chitchat'", "'chitchat'", 0.7),
        (f"{sql_any('q', RECENT)} and len(list_filter({words}, lambda w: strlen(w) >= 3 and w not in {sql_list(NO_TOPIC)})) > 0 and label <> 'fresh'", "'fresh'", 0.7),
        (f"label = 'fresh' and not {sql_any('q', RECENT)} and (starts_with(q, 'how ') or starts_with(q, 'why ') or starts_with(q, 'what causes'))", "case when starts_with(q, 'how ') then 'how-to' else 'informational' end", 0.6),
        (f"len(list_filter({words}, lambda w: w in {sql_list(CODE_WORDS)} or regexp_replace(w, 's+$', '') in {sql_list(CODE_WORDS)})) > 0 and ({sql_any('q', DOC_WORDS)} or len({words}) >= 2) and label <> 'technical'", "'technical'", 0.6),
    ]
    out, before = [], table
    for i, (when, name, floor) in enumerate(stages):
        out.append(f"i{i} as (select * exclude (label, conf), case when {when} then {name} else label end as label, case when {when} then greatest(conf, {floor}) else conf end as conf from {before})")
        before = f"i{i}"
    return ", ".join(out) + f", intents as (select * from {before})"


# --- plain functions over one query ---


def spoken_to_digits(text: str) -> str:
    """Runs of number words as digits; a run starts with a unit or ten, scales multiply what stands before them."""
    out: list[str] = []
    words = text.lower().split()
    at = 0
    while at < len(words):
        if words[at] not in NUMBERS:
            out.append(words[at])
            at += 1
            continue
        total = current = 0
        while at < len(words) and (words[at] in NUMBERS or words[at] in SCALES):
            if words[at] in SCALES:
                total, current = total + (current or 1) * SCALES[words[at]], 0
            else:
                current += NUMBERS[words[at]]
            at += 1
        out.append(str(total + current))
    return " ".join(out)


_PRICE_RULES = [(re.compile(rf"(?i)\b{form}\s*\$?\s*(\d[\d.,]*)"), sign) for sign, forms in (("<", UPPER_FORMS), (">", LOWER_FORMS)) for form in forms]
_SPACE_RULES = [(re.compile(rf"(?i)\b(?:{form})"), name) for form, name in SPACED]
_FOLLOWS_UNIT = re.compile(r"\s*(\w+)")


def canonical_operators(text: str) -> str:
    """Spoken bounds and spaced operators in their written form; a number before a unit of time stays."""
    text = spoken_to_digits(text)
    for rule, sign in _PRICE_RULES:

        def bound(m: re.Match, sign=sign, text=text) -> str:
            after = _FOLLOWS_UNIT.match(text, m.end())
            return m.group() if after and after.group(1).lower() in TIME_UNITS else f"price:{sign}{m.group(1)}"

        text = rule.sub(bound, text)
    for rule, name in _SPACE_RULES:
        text = rule.sub(name, text)
    return text


def _price(value: str) -> tuple[float | None, float | None]:
    clean = re.sub(r"[^0-9.-]", "", value)
    number = lambda s: float(s) if re.fullmatch(r"\d+\.?\d*|\.\d+", s) else None
    if clean.count("-") == 1:
        low, high = clean.split("-")
        return number(low), number(high)
    found = number(clean)
    return (found, None) if value.lstrip().startswith(">") else (None, found)


_MARK = re.compile(r"(?i)(?:^|(?<=\s))(?:" + "|".join(sorted(NEGATIONS, key=len, reverse=True)) + r")\s+|(?:^|(?<=\s))-(?=\w)")
_STOP_AT = re.compile(r"(?i)\b(?:but|for|with|in|on|that|which|learn|using|and then)\b|[,.;]")
_REFER = re.compile(r"(?i)\b(?:" + "|".join(REFERENCES) + r")\s+(\S+)")
_COMPARE = re.compile(r"(?i)\b(?:" + "|".join(COMPARISONS) + r")\s+(\S+)")
_ALTERNATIVE = ("alternative to", "alternatives to")


def _named_after(phrases) -> str:
    return r"(?i)(?:^|\s)(?:" + "|".join(phrases) + r")\s+(\S+)"


#: What a query refers to, compares with, and asks for alternatives to.
RELATIONS = {"references": _named_after(REFERENCES), "comparisons": _named_after(COMPARISONS), "replaced": _named_after(_ALTERNATIVE)}


def named(text: Column, relation: str) -> Column:
    """The words that stand after the phrases of a relation, in lower case and without marks around them."""
    found = F.regexp_extract_all(text, F.lit(RELATIONS[relation]), 1)
    return F.filter(F.transform(found, lambda w: F.lower(F.regexp_replace(w, "^[.,;]+|[.,;]+$", ""))), lambda w: w != "")


def sql_named(text: str, relation: str) -> str:
    pattern = RELATIONS[relation].replace("'", "''")
    return f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda w: lower(regexp_replace(w, '^[.,;]+|[.,;]+$', '', 'g'))), lambda w: w <> '')"


_OPERATOR = re.compile(r"(?i)(?<!\S)(-?)(" + "|".join(OPERATORS) + r"):(\S*)")
_WORD = re.compile(r"[^\W_][\w.+#-]*")


def constraints(text: str) -> dict:
    """The structured constraints of a query: phrases, operators, exclusions, references, topics."""
    plain = text.translate(str.maketrans("“”‘’", '""""'))
    quoted_parts = [p.strip() for p in re.findall(r'"([^"]*)"', plain) if p.strip()]
    rest = canonical_operators(re.sub(r'"[^"]*"', " ", plain).replace('"', " "))
    out: dict = {k: [] for k in ("positive", "negative", "file_types", "sites", "intitle", "inurl", "intext", "related")}
    out |= {"phrases": quoted_parts, "language": None, "after_date": None, "before_date": None, "price_min": None, "price_max": None, "references": [], "comparisons": []}
    lists = {"filetype": "file_types", "site": "sites", "intitle": "intitle", "inurl": "inurl", "intext": "intext", "related": "related"}
    for sign, name, value in _OPERATOR.findall(rest):
        name, value = name.lower(), value.lower()
        if not value:
            continue
        if name == "price":
            low, high = _price(value)
            out["price_min"], out["price_max"] = (low if low is not None else out["price_min"]), (high if high is not None else out["price_max"])
        elif sign and name in ("site", "filetype"):
            out["negative"].append(f"{name}:{value}")
        elif name in lists:
            out[lists[name]].append(value)
        elif name == "lang":
            out["language"] = value
        else:
            out[f"{name}_date"] = out[f"{name}_date"] or value
    rest = " ".join(_OPERATOR.sub(" ", rest).split())
    for rule, kind in ((_REFER, "references"), (_COMPARE, "comparisons")):
        out[kind] = [x.strip(".,;").lower() for x in rule.findall(rest)]
    # alternatives to a thing exclude the thing itself
    out["negative"] += [x.strip(".,;").lower() for x in re.findall(r"(?i)\balternatives? to\s+(\S+)", rest)]
    kept, at = [], 0
    for mark in _MARK.finditer(rest):
        if mark.start() < at:
            continue
        kept.append(rest[at : mark.start()])
        at = mark.end()
        first = _WORD.match(rest, at)
        if mark.group().strip().lower() == "no" and first and first.group().lower() in NO_COMPOUNDS:
            out["positive"].append("no" + first.group().lower())
            at = first.end()
            continue
        # a list of single words joined by and / or / commas is excluded word by word
        while first:
            word = first.group().lower()
            if word not in GENERIC and len(word) > 1:
                out["negative"].append(word)
            at = first.end()
            joined = re.compile(r"(?i)\s*(?:,|\band\b|\bor\b|\bnor\b)\s*(?:not\s+)?").match(rest, at)
            if not joined or not joined.group().strip():
                break
            first = _WORD.match(rest, joined.end())
    kept.append(rest[at:])
    for part in kept:
        run: list[str] = []
        for token in [*part.split(), "the"]:
            word = token.strip(".,;:!?()").lower()
            if not word or word in GENERIC or word in DANGLING or word in FILLERS or token.endswith(","):
                if word and token.endswith(",") and word not in GENERIC:
                    run.append(word)
                while run:  # paired from the end, at most two words each
                    out["positive"].append(" ".join(run[-2:]))
                    del run[-2:]
            else:
                run.append(word)
    negative = sorted({n.lower() for n in out["negative"] if 2 <= len(n.encode()) <= 50})
    out["positive"] = sorted({p for p in out["positive"] if 2 <= len(p.encode()) <= 50 and not any(p == n or n in p.split() for n in negative)})
    out["negative"] = negative
    return out


def compressed(text: str, stops: frozenset[str], technical: frozenset[str]) -> str:
    """Over eight words only the most telling ones stay, in their order."""
    words = text.split()
    if len(words) <= 8:
        return text
    scored = []
    for i, word in enumerate(words):
        clean = "".join(c for c in word.lower() if c.isalnum() or c in ".+#")
        if not clean:
            continue
        score = (0.0 if clean in stops else 1.0) + 2.0 * (clean in technical)
        opens = i == 0 or words[i - 1][-1] in ".!?"
        score += 1.5 * (not opens and word[0].isupper())
        score += 1.5 * (len(word) >= 2 and all(c.isupper() or not c.isalpha() for c in word))
        score = (score + 0.5 * (len(clean) >= 6)) * (1 - 0.3 * i / len(words))
        if score > 0:
            scored.append((-score, i))
    best = sorted(i for _, i in sorted(scored)[: 14 if len(words) > 20 else 10])
    return " ".join(words[i] for i in best) or text


# our own choice: variants of a query for each intent
TEMPLATES = {
    "how-to": ("{q}", "{q} tutorial", "{q} step by step guide"), "comparison": ("{q}", "{q} comparison", "{q} pros and cons"), "technical": ("{q}", "{q} documentation", "{q} examples"),
    "transactional": ("{q}", "{q} price", "{q} buy"), "navigational": ("{q}", "{q} official site"), "fresh": ("{q}", "{q} news", "{q} latest updates"), "informational": ("{q}", "{q} explained", "{q} overview"),
}


def expansions(text: str, intent_label: str, negative: list[str], references: list[str]) -> list[str]:
    """Variants of a query; the one without its exclusions comes second."""
    variants = [t.format(q=text) for t in TEMPLATES.get(intent_label, ("{q}",))]
    if negative:
        stripped = " ".join(w for w in _MARK.sub(" ", text).split() if w.strip(".,").lower() not in negative)
        variants.insert(1, stripped)
    variants += [f"{r} alternatives" for r in references]
    sides = [s.strip() for s in re.split(r"(?i)\s+(?:vs|versus)\.?\s+", text)]
    if len(sides) > 1:
        variants += [f"{a} vs {b}" for i, a in enumerate(sides) for b in sides[i + 1 :]] + sides
    out: list[str] = []
    for v in variants:
        words = v.split()
        words = [w for i, w in enumerate(words) if i == 0 or w.lower() != words[i - 1].lower()]
        while words and words[0].lower() in DANGLING:
            words.pop(0)
        while words and words[-1].lower() in DANGLING:
            words.pop()
        v = " ".join(words)
        if v and v.lower() not in {o.lower() for o in out}:
            out.append(v)
    return out


# fixed values: nouns of verbs
STEMS = {
    "securing": "security", "configure": "configuration", "configuring": "configuration", "deploy": "deployment", "deploying": "deployment", "manage": "management", "managing": "management",
    "monitor": "monitoring", "monitoring": "monitoring", "test": "testing", "testing": "testing", "debug": "debugging", "debugging": "debugging", "develop": "development", "developing": "development",
    "build": "build", "building": "build", "install": "installation", "installing": "installation", "authenticate": "authentication", "authenticating": "authentication", "authorize": "authorization",
    "authorizing": "authorization", "encrypt": "encryption", "encrypting": "encryption", "decrypt": "decryption", "decrypting": "decryption", "validate": "validation", "validating": "validation",
    "sanitize": "sanitization", "sanitizing": "sanitization", "hash": "hashing", "hashing": "hashing", "compress": "compression", "compressing": "compression", "decompress": "decompression",
    "decompressing": "decompression", "serialize": "serialization", "serializing": "serialization", "deserialize": "deserialization", "deserializing": "deserialization", "encode": "encoding",
    "encoding": "encoding", "decode": "decoding", "decoding": "decoding", "parse": "parsing", "parsing": "parsing", "compile": "compilation", "compiling": "compilation",
    "interpret": "interpretation", "interpreting": "interpretation", "optimize": "optimization", "optimizing": "optimization", "profile": "profiling", "profiling": "profiling", "log": "logging",
    "logging": "logging", "trace": "trace", "tracing": "trace", "report": "report", "reporting": "report",
}


def stem(word: Column) -> Column:
    """Noun of a verb, else the word without its suffix."""
    w, n = F.lower(word), F.octet_length(F.lower(word))
    table = F.create_map(*[F.lit(x) for p in STEMS.items() for x in p])
    cut = lambda k: w.substr(F.lit(1), F.length(w) - k)
    ends = lambda s: F.endswith(w, F.lit(s))
    base = cut(3)
    doubled = F.rlike(base, F.lit("[ngtd]$")) & (F.length(base) - 1 >= 2)
    return (
        F.when(F.try_element_at(table, w).isNotNull(), F.try_element_at(table, w))
        .when(ends("ing") & (n > 4), F.when(doubled, cut(4)).otherwise(base))
        .when((ends("ment") | ends("ness") | ends("able")) & (n > 4), cut(4))
        .when((ends("ous") | ends("ive")) & (n > 3), cut(3))
        .when((ends("er") | ends("or")) & (n > 3), cut(2))
        .when(ends("s") & (n > 2) & ~ends("ss"), cut(1))
        .otherwise(w)
    )


def sql_stem(word: str) -> str:
    w = f"lower({word})"
    table = f"case {w} " + " ".join(f"when '{k}' then '{v}'" for k, v in STEMS.items()) + " end"
    cut = lambda k: f"substr({w}, 1, length({w}) - {k})"
    return f"""case when {table} is not null then {table} when ends_with({w}, 'ing') and strlen({w}) > 4 then case when regexp_matches({cut(3)}, '[ngtd]$') and length({w}) - 4 >= 2 then {cut(4)} else {cut(3)} end
        when (ends_with({w}, 'ment') or ends_with({w}, 'ness') or ends_with({w}, 'able')) and strlen({w}) > 4 then {cut(4)} when (ends_with({w}, 'ous') or ends_with({w}, 'ive')) and strlen({w}) > 3 then {cut(3)}
        when (ends_with({w}, 'er') or ends_with({w}, 'or')) and strlen({w}) > 3 then {cut(2)} when ends_with({w}, 's') and strlen({w}) > 2 and not ends_with({w}, 'ss') then {cut(1)} else {w} end"""
