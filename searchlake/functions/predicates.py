"""Filters: junk, family filter, dictionaries, lists, spam, goals, query kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlake.functions.dialect import has_any, quoted, sql_any, sql_list, sql_starts, starts_any

# fixed values: phrases that mark a page without content
FETCH_ERRORS = (
    "we cannot provide a description for this page right now",
    "we can't provide a description for this page right now",
    "cannot provide a description for this page right now",
    "we couldn't find a description for this page",
)
# fixed values: words of the family filter
ADULT_TOKENS = (
    "porn", "porno", "xxx", "xhamster", "xnxx", "xvideos", "pornhub", "youporn", "redtube", "nude", "nudes", "naked", "sex", "sexual", "sexy", "fuck",
    "fucking", "fucked", "cum", "cumshot", "cumming", "dick", "pussy", "cock", "penis", "vagina", "boobs", "tits", "milf", "dilf", "slut", "whore", "bitch",
    "onlyfans", "nsfw", "erotic", "erotica", "escort", "blowjob", "blow job", "handjob", "rimjob", "anal", "orgasm", "orgy", "threesome", "fetish", "bdsm",
    "sucking", "suck", "gangbang", "pegging", "hentai", "fap", "horny", "screwing", "foursome", "hooker", "prostitute", "masturbat", "masturbate", "rape",
    "incest", "cunnilingus", "sodom", "cuckold", "creampie", "deepthroat", "assfuck", "buttfuck", "adultvideo", "adult film", "adult movie", "adult content",
    "hardcore", "softcore", "lingerie model", "webcam model", "camgirl", "cam boy", "only fans",
)
URL_ONLY = ("adult",)
NOT_IN_URLS = ("sex", "cock", "cum", "anal")
ADULT_PHRASES = (
    "moms teach sex", "mom teaches sex", "mother son", "daughter father", "incest porn", "family sex", "step sister", "step brother", "lesbian porn", "gay porn",
    "teen porn", "amateur porn", "anal sex", "adult video", "adult film", "adult movie", "webcam model", "only fans", "naked girls", "naked women", "hot sex", "free porn",
)
# fixed values: signs of a dictionary page
PHONETIC = ("/ˈ", "/ˌ", "/'", "/-")
PARTS_OF_SPEECH = ("noun", "verb", "adjective", "adverb", "preposition", "conjunction", "interjection", "pronoun", "determiner", "abbreviation")
LEXICON_TITLES = ("意味", "読み方", "翻訳", "的意思", "뜻", "사전")
DICTIONARY_TITLES = ("| meaning", ": meaning", "definition & meaning", "cambridge dictionary", "dictionary.com", "merriam-webster", "wiktionary")
# fixed values: commercial words
SPAM_WORDS = ("services", "write my paper", "essay", "buy", "hire", "agency", "consulting", "price", "discount", "cheap", "assignment help", "for sale", "quote")
# fixed values: stop words of required entities
ENTITY_STOPS = (
    "the", "a", "an", "in", "on", "for", "of", "to", "with", "from", "is", "are", "was", "were", "who", "what", "when", "where", "why", "how", "do", "does", "did",
    "will", "would", "could", "should", "can", "may", "might", "me", "my", "your", "he", "she", "they", "it", "this", "that", "these", "those", "has", "have", "had",
    "been", "being", "also", "about", "into", "than", "then", "there", "here", "not", "no", "without", "except", "other", "president", "prime", "minister", "capital",
    "explain", "learn", "learning", "best", "top", "happened", "happen", "tell",
)
# fixed values: openings and phrases of the query kinds, in order of precedence
QUERY_KINDS = (
    ("joke", (), ("joke",)),
    ("who_won", ("who won", "who win"), ("winner of", "who were the winners")),
    ("factual_person", ("who is", "who was", "who were"), ()),
    ("definition", ("what is", "what are", "what was", "what were", "define"), ("definition of", "meaning of")),
    ("news_event", ("what happened",), ()),
    ("factual_thing", ("capital of", "where is", "how many", "how much"), ()),
)
NUMBERED = r"(?i)\b([0-9]{2,4})\+?\s+(funny|hilarious|corny|best|top|clean|short|good)\s+\w*\s*(joke|pun|riddle|meme|quotes?|facts?|things|ways|reasons)\b"
TOP_N = r"(?i)\b(?:top|best)\s+[0-9]{1,2}\b|\b[0-9]{1,2}\s+(?:best|top)\b"


def junk(text: Column, lenient: Column | None = None) -> Column:
    """No content: nothing, an error phrase, player or contents boilerplate, or under 15 letters and digits."""
    t, low = F.trim(text), F.lower(F.trim(text))
    few = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) < 15
    fixed = has_any(low, FETCH_ERRORS + ("toggle the table of contents", "video item preview")) | (F.contains(low, F.lit("in-browser video")) & F.contains(low, F.lit("requires javascript")))
    return (t == "") | fixed | (few if lenient is None else few & ~lenient)


def sql_junk(text: str, lenient: str | None = None) -> str:
    t, low = f"trim({text})", f"lower(trim({text}))"
    few = f"length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 15"
    few = few if lenient is None else f"({few} and not {lenient})"
    return f"({t} = '' or {sql_any(low, FETCH_ERRORS + ('toggle the table of contents', 'video item preview'))} or (contains({low}, 'in-browser video') and contains({low}, 'requires javascript')) or {few})"


def adult(title: Column, url: Column) -> Column:
    t, u = F.lower(title), F.lower(url)
    words = lambda x: F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    whole = F.array(*map(F.lit, ADULT_TOKENS))
    inside = [w for w in ADULT_TOKENS if " " not in w and w not in NOT_IN_URLS]
    return F.arrays_overlap(words(t), whole) | F.arrays_overlap(words(u), F.array(*map(F.lit, ADULT_TOKENS + URL_ONLY))) | has_any(u, inside) | has_any(F.concat(t, F.lit(" "), u), ADULT_PHRASES)


def sql_adult(title: str, url: str) -> str:
    words = lambda x: f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+')"
    inside = [w for w in ADULT_TOKENS if " " not in w and w not in NOT_IN_URLS]
    whole, urls = (f"[{', '.join(map(quoted, x))}]" for x in (ADULT_TOKENS, ADULT_TOKENS + URL_ONLY))
    return f"(list_has_any({words(title)}, {whole}) or list_has_any({words(url)}, {urls}) or {sql_any(f'lower({url})', inside)} or {sql_any(f'(lower({title}) || {quoted(' ')} || lower({url}))', ADULT_PHRASES)})"


def definition_page(title: Column, content: Column) -> Column:
    t, c = F.lower(title), F.lower(content)
    head, brief = F.left(c, F.lit(300)), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 3
    small = F.octet_length(c) < 200
    sound, part = has_any(head, PHONETIC), starts_any(head, PARTS_OF_SPEECH)
    return has_any(t, DICTIONARY_TITLES) | ((sound | part) & brief) | (part & small) | (has_any(t, LEXICON_TITLES) & (brief | small))


def sql_definition_page(title: str, content: str) -> str:
    t, c = f"lower({title})", f"lower({content})"
    head, brief = f"left({c}, 300)", f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) <= 3"
    sound, part, small = sql_any(head, PHONETIC), sql_starts(head, PARTS_OF_SPEECH), f"strlen({c}) < 200"
    return f"({sql_any(t, DICTIONARY_TITLES)} or (({sound} or {part}) and {brief}) or ({part} and {small}) or ({sql_any(t, LEXICON_TITLES)} and ({brief} or {small})))"


def listicle(title: Column, content: Column, url: Column) -> Column:
    t, c, u = F.lower(title), F.lower(content), F.lower(url)
    marked = has_any(u, ("/joke", "jokes", "pun", "riddle")) | has_any(c, ("knock knock", "why did the"))
    setup = has_any(t, ("why did the", "knock knock", "what do you call")) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) < 20)
    return F.rlike(t, F.lit(NUMBERED)) | (marked & has_any(t, ("joke", "pun", "riddle"))) | setup


def sql_listicle(title: str, content: str, url: str) -> str:
    t, c, u = f"lower({title})", f"lower({content})", f"lower({url})"
    return f"""(regexp_matches({t}, {quoted(NUMBERED)}) or (({sql_any(u, ("/joke", "jokes", "pun", "riddle"))} or {sql_any(c, ("knock knock", "why did the"))}) and {sql_any(t, ("joke", "pun", "riddle"))})
        or ({sql_any(t, ("why did the", "knock knock", "what do you call"))} and len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) < 20))"""


def spam(title: Column, url: Column) -> Column:
    u = F.lower(url)
    return has_any(F.lower(title), SPAM_WORDS) | has_any(u, [f"/{w}/" for w in SPAM_WORDS]) | has_any(u, [f"-{w}" for w in SPAM_WORDS])


def sql_spam(title: str, url: str) -> str:
    u = f"lower({url})"
    return f"({sql_any(f'lower({title})', SPAM_WORDS)} or {sql_any(u, [f'/{w}/' for w in SPAM_WORDS])} or {sql_any(u, [f'-{w}' for w in SPAM_WORDS])})"


def goal_error(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.octet_length(t) < 3, "empty_goal").when(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 3, "invalid_goal")


def sql_goal_error(text: str) -> str:
    return f"case when strlen(trim({text})) < 3 then 'empty_goal' when length(regexp_replace(trim({text}), '[^\\p{{L}}]', '', 'g')) < 3 then 'invalid_goal' end"


def query_kind(text: Column) -> Column:
    q, found = F.lower(text), F.lit("general")
    for kind, openings, phrases in reversed(QUERY_KINDS):
        hit = starts_any(q, openings) if openings else F.lit(False)
        hit = hit | has_any(q, phrases) if phrases else hit
        found = F.when(hit, kind).otherwise(found)
    return found


def sql_query_kind(text: str) -> str:
    q = f"lower({text})"
    hit = lambda o, p: " or ".join(([sql_starts(q, o)] if o else []) + ([sql_any(q, p)] if p else []))
    return "case " + " ".join(f"when {hit(o, p)} then '{k}'" for k, o, p in QUERY_KINDS) + " else 'general' end"


def required_entities(text: Column) -> Column:
    bare = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(bare, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*ENTITY_STOPS) & ~F.rlike(w, F.lit("^[0-9]+$")))


def sql_required_entities(text: str) -> str:
    bare = f"list_transform(regexp_split_to_array(trim({text}), '\\s+'), lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')))"
    return f"list_filter({bare}, lambda w: strlen(w) >= 2 and w not in {sql_list(ENTITY_STOPS)} and not regexp_matches(w, '^[0-9]+$'))"
