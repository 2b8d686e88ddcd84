"""Text expressions: folding, slugs, winner-market and party patterns, fields of a question."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of questions that are not about who wins.
NOT_WINNER = [
    r"vote\s+share", r"popular\s+vote\s*%", r"more\s+than\s+\d+", r"at\s+least\s+\d+", r"fewer\s+than\s+\d+", r"less\s+than\s+\d+",
    r"\d+\s*%\s+of\s+(the\s+)?votes?", r"between\s+\d+\s*%?\s+and\s+\d+", r"by\s+\d+\s+point", r"margin\s+of", r"margin\s+in", r"win\s+by\s+more",
    r"percentage", r"total\s+votes", r"turnout", r"electoral\s+vote", r"\d+\s+swing\s+state", r"swing\s+state.*\d+",
    r"drop\s*out", r"withdraw", r"resign", r"suspend\s+(his|her|their)?\s*campaign", r"how\s+many", r"number\s+of", r"\bendorse\b", r"endorsement",
    r"\bdebate\b", r"\bspeech\b", r"state\s+of\s+the\s+union", r"\bapproval\b", r"favorability", r"\brating\b", r"polling\s+average",
    r"\bannounce\b", r"file\s+to\s+run", r"enter\s+the\s+race",
    r"before\s+(january|february|march|april|may|june|july|august|september|october|november|december)",
    r"by\s+(january|february|march|april|may|june|july|august|september|october|november|december)",
    r"by\s+end\s+of", r"by\s+the\s+end\s+of", r"still\s+in\s+office", r"leave\s+office", r"\bconvicted\b", r"\bindicted\b", r"\bsentenced\b", r"prison\s+time",
    r"runoff", r"second\s+round",
]
# Patterns of questions about who wins.
WINNER = [
    r"\bwin\b", r"\bwins\b", r"\bwinner\b", r"\bwinning\b", r"\bvictory\b", r"\bvictorious\b", r"\belected\b", r"\belect\b", r"\bcontrol\b", r"\bflip\b", r"\bmajority\b", r"\bvs\.?\b",
    r"\bbe\s+(the\s+)?(governor|senator|president|mayor|representative|rep\.|congressman|congresswoman|prime\s+minister|chancellor|premier)\b",
    r"\bbe\s+(the\s+)?next\s+(governor|senator|president|mayor|prime\s+minister)\b", r"\bstill\s+be\s+(a\s+)?(governor|senator|president|mayor)\b",
    r"\bnominee\b", r"\bnomination\b", r"\bnom\b", r"\bprimary\b", r"\bfirst\s+place\b",
    r"\b(democrat|republican|dem|rep|D|R)\s+(win|wins|victory|control)\b", r"\b(democratic|republican)\s+(party|candidate)\b",
]
# Letters that are spelled with others, Latin ones without a plain form, and the Greek and Cyrillic alphabets.
SPELLED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ə": "e", "Ə": "E",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "\u00a0": " ",
}


def _letters() -> tuple[str, str, dict[str, str]]:
    """Letters of one plain letter and those letters, and letters of several: the spelled ones in both cases, and all Latin, Greek and Cyrillic letters with marks, whose plain forms Unicode gives."""
    table = dict(SPELLED)
    for k, v in SPELLED.items():
        if k.upper() != k and len(k.upper()) == 1:
            table.setdefault(k.upper(), v.capitalize())
    for point in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFKD", chr(point))[0]
        if base != chr(point):
            plain = base if base.isascii() else table.get(base)
            if plain is not None:
                table.setdefault(chr(point), plain)
    single = {k: v for k, v in table.items() if len(v) == 1}
    return "".join(single), "".join(single.values()), {k: v for k, v in table.items() if len(v) > 1}


MARKED, PLAIN, LONGER = _letters()
# Particles that belong to a surname.
PARTICLES = ["de", "del", "la", "van", "von", "da", "dos", "das"]
# The city scopes of event ids.
CITIES = "NYC LA CHICAGO SF BOSTON ATLANTA MIAMI DETROIT OAKLAND SEATTLE DENVER HOUSTON DALLAS PHILA PHOENIX SAN_ANTONIO SAN_DIEGO AUSTIN MINNEAPOLIS PITTSBURGH CLEVELAND NEW_ORLEANS CHARLOTTE ALBUQUERQUE JERSEY_CITY".split()
# The states and districts with a two-letter code.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def is_electoral(category: Column) -> Column:
    return F.coalesce(category.startswith("1.") | F.upper(category).contains("ELECTORAL"), F.lit(False))


def resolved(platform: Column, result: Column) -> Column:
    """1 or 0 by a market's result, null while it has none: Yes or No exactly, for kalshi also in lower case."""
    low = (platform == "kalshi") & result.isin("yes", "no")
    return F.when(result.isin("Yes", "No") | low, (F.lower(result) == "yes").cast("int"))


def is_winner_question(question: Column) -> Column:
    return F.coalesce(~question.rlike(any_of(NOT_WINNER)) & question.rlike(any_of(WINNER)), F.lit(False))


def fold(text: Column) -> Column:
    """Letters of the Latin, Greek and Cyrillic alphabets as plain ones, marks and other characters beyond ASCII dropped.  Text that is plain already is left as it is."""

    longer = F.from_json(F.lit(json.dumps(LONGER)), "map<string,string>")  # one constant in the plan

    def plain(t: Column) -> Column:
        letters = F.split(F.translate(t, MARKED, PLAIN), "")
        spelled = F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(longer, c), c)), "")
        return F.when(F.regexp_like(t, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(spelled, r"[^\x00-\x7F]", "")).otherwise(t)

    # inside a lambda function, so that text stands once in the plan however often it is folded again
    return F.transform(F.array(text), plain)[0]


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def slug(text: Column) -> Column:
    """Upper case, other characters as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(fold(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def name_slug(name: Column) -> Column:
    """The last name, with the particle before it if there is one."""

    def last_of(parts: Column) -> Column:
        last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
        whole = F.when(F.lower(before).isin(PARTICLES), F.concat(before, F.lit("_"), last)).otherwise(last)
        return F.regexp_replace(F.regexp_replace(F.upper(whole), "[^A-Z0-9]+", "_"), "^_+|_+$", "")

    return F.transform(F.array(F.filter(F.split(fold(name), r"\s+"), lambda p: p != "")), last_of)[0]


def number_slug(value: Column) -> Column:
    """4.5 as 4P5, whole thousands, millions and billions as K, M, B; a minus sign as N."""
    size = F.abs(value)
    whole = F.floor(size).cast("string")
    big = F.when(size >= 1e9, F.concat(F.floor(size / 1e9).cast("string"), F.lit("B"))).when(size >= 1e6, F.concat(F.floor(size / 1e6).cast("string"), F.lit("M"))).when(size >= 1e3, F.concat(F.floor(size / 1e3).cast("string"), F.lit("K"))).otherwise(whole)
    out = F.when(size == F.floor(size), big).otherwise(F.replace(size.cast("string"), F.lit("."), F.lit("P")))
    return F.when(value < 0, F.concat(F.lit("N"), out)).otherwise(out)


def site_slug(text: Column, longest: int = 60) -> Column:
    """Lower case, other than word characters dropped, blanks and underscores as one dash."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[\s_-]+", "-"), "^-+|-+$", ""), 1, longest)


def valid_scope(scope: Column) -> Column:
    s = F.upper(scope)
    return F.coalesce(s.isin(CITIES) | s.rlike(r"^[A-Z]{2}-\d+$") | s.isin(STATES), F.lit(False))


def party(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("democratic|democrat |dem primary|dem nominee"), "Democratic").when(low.rlike("republican|gop|rep primary|rep nominee"), "Republican")


def normal_party(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("r", "rep", "gop", "republican", "republicans"), "Republican").when(low.isin("d", "dem", "democrat", "democratic", "democrats"), "Democrat").otherwise(text)


def candidate(question: Column) -> Column:
    """The name a question asks about, by the first of four forms that fits."""
    group = lambda pattern: F.nullif(F.trim(F.regexp_extract(question, pattern, 1)), F.lit(""))
    wins = F.regexp_replace(group(r"(?i)Will\s+(.+?)\s+win"), r"(?i)\s+(the|a|an)\s*$", "")
    dashed = group(r"-\s*([A-Za-z][A-Za-z\s]+?)\s*\??$")
    found = F.coalesce(wins, group(r"(?i)Will?\s+(.+?)\s+be\s+the\s+(?:Democratic|Republican|GOP)\s+nominee"), group(r"(?i)^(.+?)\s+to\s+win"), F.when(F.length(dashed) < 50, dashed))
    return F.when(~question.rlike(r"(?i)who\s+will\s+(run|enter|announce)"), found)


def year(question: Column, close_year: Column | None = None) -> Column:
    """The first year from 1990 to 2100 in the text, else that of the close."""
    found = F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"\b((?:19|20|21)\d\d)\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1990, 2100))
    first = F.try_element_at(found, F.lit(1))
    return first if close_year is None else F.coalesce(first, close_year)


def scope(question: Column) -> Column:
    """District code, else state by full name, else null."""
    district = F.nullif(F.regexp_extract(question, r"\b([A-Z]{2}-\d{1,2})\b", 1), F.lit(""))
    named = F.coalesce(*[F.when(question.rlike(rf"(?i)\b{name}\b"), code) for name, code in STATE_NAMES.items()])
    return F.coalesce(district, named)


# State names of two words first, so that none hides in another.
STATE_NAMES = {
    "West Virginia": "WV", "North Carolina": "NC", "South Carolina": "SC", "North Dakota": "ND", "South Dakota": "SD", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "Rhode Island": "RI",
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "Wisconsin": "WI", "Wyoming": "WY",
}


# Election type by office, for general and primary elections of the United States.
US_TYPES = {
    "President": ("Presidential", "Presidential Primary"), "Vice President": ("VP Nomination", "VP Nomination"), "Senate": ("Senate", "Senate Primary"), "House": ("House", "House Primary"), "Governor": ("Gubernatorial", "Gubernatorial Primary"), "Mayor": ("Mayoral", "Mayoral Primary"),
    "Lt. Governor": ("Gubernatorial", "Gubernatorial Primary"), "Attorney General": ("Gubernatorial", "Gubernatorial Primary"), "Secretary of State": ("Gubernatorial", "Gubernatorial Primary"),
}
# Election type by office elsewhere.
OTHER_TYPES = {"President": ("Presidential", "Presidential Primary"), "Prime Minister": ("Prime Minister",) * 2, "Chancellor": ("Chancellor",) * 2, "Parliament": ("Parliamentary",) * 2, "European Parliament": ("European Parliament",) * 2, "Regional": ("Regional Election",) * 2, "Mayor": ("Mayoral", "Mayoral Primary")}
REVIEW = "OTHER_NEEDS_REVIEW"


def election_type(office: Column, primary: Column, country: Column) -> Column:
    """Kind of election; null without an office and for offices of the United States that are not listed."""
    pick = lambda table: F.coalesce(*[F.when(office == k, F.when(F.coalesce(primary, F.lit(False)), b).otherwise(a)) for k, (a, b) in table.items()])
    return F.when(office.isNotNull(), F.when(F.coalesce(country == "United States", F.lit(False)), pick(US_TYPES)).otherwise(F.coalesce(pick(OTHER_TYPES), F.lit(REVIEW))))


def category_label(category: Column) -> Column:
    """`12. SOME_NAME` as `Some Name`."""
    return F.initcap(F.replace(F.lower(F.regexp_replace(category, r"^\d+[.-]\s*", "")), F.lit("_"), F.lit(" ")))


# Countries that tickers name, longer names first.
TICKER_COUNTRIES = {
    "SOUTHAFRICA": "ZA", "SOUTHKOREA": "KR", "NETHERLANDS": "NL", "PHILIPPINES": "PH", "THEGAMBIA": "GM", "ARGENTINA": "AR", "AUSTRALIA": "AU", "INDONESIA": "ID", "SINGAPORE": "SG", "VENEZUELA": "VE", "COLOMBIA": "CO", "MALAYSIA": "MY", "THAILAND": "TH", "DENMARK": "DK", "ECUADOR": "EC", "FINLAND": "FI", "GERMANY": "DE", "IRELAND": "IE",
    "BRAZIL": "BR", "CANADA": "CA", "FRANCE": "FR", "GAMBIA": "GM", "ISRAEL": "IL", "MEXICO": "MX", "NORWAY": "NO", "POLAND": "PL", "SWEDEN": "SE", "TAIWAN": "TW", "TURKEY": "TR", "CHILE": "CL", "INDIA": "IN", "ITALY": "IT", "JAPAN": "JP", "KOREA": "KR", "SPAIN": "ES", "PERU": "PE", "UK": "GB",
}


def ticker_fields(ticker: Column) -> Column:
    """office, scope, year, party and country from a ticker such as SENATEMD-28-R; two-digit years are 20xx."""
    t = F.regexp_replace(F.upper(ticker), "^KX", "")
    head, rest = F.substring_index(t, "-", 1), F.concat(F.lit("-"), F.regexp_replace(t, r"^[^-]*-?", ""), F.lit("-"))
    office = F.when(head.startswith("SENATE"), "SEN").when(head.startswith("HOUSE"), "HOUSE").when(head.startswith("GOV"), "GOV").when(head.contains("PRES"), "PRES").when(head.contains("PARL"), "PARL").when(head.contains("ATTYGEN"), "AG").when(head.contains("MAYOR"), "MAYOR")
    district = F.regexp_extract(head, r"^HOUSE([A-Z]{2})(\d{1,2})$", 1)
    scope = F.when(district != "", F.concat_ws("-", district, F.regexp_extract(head, r"^HOUSE([A-Z]{2})(\d{1,2})$", 2))).otherwise(F.nullif(F.regexp_extract(head, r"^(?:SENATE|GOV|ATTYGEN)([A-Z]{2})$", 1), F.lit("")))
    four, two = F.regexp_extract(rest, r"-((?:19|20|21)\d\d)-", 1), F.regexp_extract(rest, r"-(\d\d)(?:[A-Z]{3}\d{0,2})?-", 1)
    year = F.when(four != "", four.try_cast("int")).when(two != "", two.try_cast("int") + 2000)
    side = F.coalesce(*[F.when(rest.endswith(f"-{end}-"), code) for end, code in (("R", "GOP"), ("D", "DEM"), ("LEFT", "LEFT"), ("RIGHT", "RIGHT"))])
    named = F.regexp_extract(head, "(" + "|".join(TICKER_COUNTRIES) + ")", 1)
    country = F.when(scope.isNotNull(), "US").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in TICKER_COUNTRIES.items() for x in pair]), named))
    return F.struct(office.alias("office"), scope.alias("scope"), year.alias("year"), side.alias("party"), country.alias("country"))


def with_hints(frame: Column, hints: Column) -> Column:
    """frame whose empty office, scope, year, party and country are filled from hints."""
    for f in ("office", "scope", "year", "party", "country"):
        frame = frame.withField(f, F.coalesce(frame[f], hints[f]))
    return frame


def url(base: str, slug: Column) -> Column:
    return F.when(slug.isNotNull() & (slug != ""), F.concat(F.lit(base), slug))


def location_hint(question: Column) -> Column:
    """state, district and confidence of a question: a district code or a numbered congressional district, else state names; low where several are named, the alphabetically first then stands."""
    code, number = (F.regexp_extract(question, r"\b([A-Z]{2})-(\d{1,2})\b", k) for k in (1, 2))
    by_code = F.create_map(*[F.lit(x) for n, c in STATE_NAMES.items() for x in (c, n)])
    code_of = F.create_map(*[F.lit(x) for n, c in STATE_NAMES.items() for x in (n.lower(), c)])
    names = "|".join(STATE_NAMES)
    pattern = rf"(?i)\b({names})(?:'s)?\s+(\d{{1,2}})(?:st|nd|rd|th)\s+congressional"
    state, seat = F.lower(F.regexp_extract(question, pattern, 1)), F.regexp_extract(question, pattern, 2)
    whole = lambda n: n.try_cast("int").cast("string")  # noqa: E731  leading zeros go
    hint = lambda s, d, c: F.struct(s.cast("string").alias("state"), d.cast("string").alias("district"), c.cast("string").alias("confidence"))
    named = F.array_sort(F.array_compact(F.array(*[F.when(F.regexp_like(question, F.lit(rf"(?i)\b{n}\b")), n) for n in STATE_NAMES])))
    none = F.lit(None)
    return (
        F.when(F.try_element_at(by_code, code).isNotNull(), hint(F.try_element_at(by_code, code), F.concat_ws("-", code, whole(number)), F.lit("high")))
        .when(state != "", hint(F.initcap(state), F.concat_ws("-", F.try_element_at(code_of, state), whole(seat)), F.lit("high")))
        .when(F.size(named) == 1, hint(F.try_element_at(named, F.lit(1)), none, F.lit("high")))
        .when(F.size(named) > 1, hint(F.try_element_at(named, F.lit(1)), none, F.lit("low")))
        .otherwise(hint(none, none, none))
    )


def year_hint(question: Column, close_year: Column, close_month: Column) -> Column:
    """year and confidence: the only year named (high), the earliest of several (low), else that of a close from 2020 to 2030, the year before if it closes by March (medium)."""
    years = F.transform(F.regexp_extract_all(question, F.lit(r"\b(202\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    guess = F.when(close_year.between(2020, 2030), close_year - F.when(close_month <= 3, 1).otherwise(0))
    hint = lambda y, c: F.struct(y.cast("int").alias("year"), c.cast("string").alias("confidence"))
    return F.when(F.size(years) == 1, hint(F.try_element_at(years, F.lit(1)), F.lit("high"))).when(F.size(years) > 1, hint(F.array_min(years), F.lit("low"))).otherwise(hint(guess, F.when(guess.isNotNull(), "medium")))


def location_chain(fields: Column, ticker: Column, slug: Column, question: Column, default: Column) -> Column:
    """Where a market is: its own field, else what its ticker, its slug or its question names, else its category's default.  The first that is there wins."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(fields), ticker_fields(ticker)["scope"], scope(F.replace(slug, F.lit("-"), F.lit(" "))), scope(question), default)
