"""Dictionaries of political entities, and the first entry of one that a text names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.functions.text import STATE_NAMES, fold

# Frame type by verb.
VERBS = {
    "win": "contest", "defeat": "contest", "beat": "contest", "run": "contest",
    "appoint": "appointment", "nominate": "appointment", "confirm": "appointment", "replace": "appointment", "succeed": "appointment",
    "raise": "policy_change", "lower": "policy_change", "cut": "policy_change", "hike": "policy_change", "increase": "policy_change", "decrease": "policy_change",
    "reach": "threshold", "hit": "threshold", "exceed": "threshold", "surpass": "threshold", "fall": "threshold", "drop": "threshold", "rise": "threshold", "climb": "threshold",
    "pass": "legislation", "enact": "legislation", "veto": "legislation", "repeal": "legislation",
    "rule": "ruling", "overturn": "ruling", "uphold": "ruling", "strike": "ruling", "affirm": "ruling",
    "ban": "regulatory_action", "impose": "regulatory_action", "sanction": "regulatory_action", "restrict": "regulatory_action", "approve": "regulatory_action", "authorize": "regulatory_action", "revoke": "regulatory_action", "suspend": "regulatory_action",
    "agree": "agreement", "sign": "agreement", "negotiate": "agreement", "ratify": "agreement",
    "declare": "declaration", "announce": "declaration", "claim": "declaration", "recognize": "declaration",
    "poll": "metric", "rate": "metric", "measure": "metric",
    "happen": "occurrence", "occur": "occurrence", "begin": "occurrence", "start": "occurrence", "end": "occurrence", "resign": "occurrence", "die": "occurrence", "leave": "occurrence", "withdraw": "occurrence",
}
# Forms of verbs that no rule gives.
IRREGULAR = {"won": "win", "winning": "win", "beaten": "beat", "ran": "run", "running": "run", "cutting": "cut", "hitting": "hit", "fell": "fall", "fallen": "fall", "dropped": "drop", "dropping": "drop", "rose": "rise", "risen": "rise", "upheld": "uphold", "struck": "strike", "banned": "ban", "banning": "ban", "began": "begin", "begun": "begin", "beginning": "begin", "left": "leave", "withdrew": "withdraw", "vetoes": "veto", "vetoed": "veto", "dying": "die"}
# Frame type by participle after a form of `be`.
PARTICIPLES = {
    "elected": "contest", "defeated": "contest", "nominated": "contest", "confirmed": "appointment", "appointed": "appointment", "replaced": "appointment",
    "passed": "legislation", "enacted": "legislation", "signed": "legislation", "vetoed": "legislation", "repealed": "legislation",
    "overturned": "ruling", "upheld": "ruling", "struck": "ruling", "affirmed": "ruling", "ruled": "ruling",
    "banned": "regulatory_action", "imposed": "regulatory_action", "sanctioned": "regulatory_action", "approved": "regulatory_action", "authorized": "regulatory_action", "revoked": "regulatory_action", "suspended": "regulatory_action",
    "ratified": "agreement", "impeached": "occurrence", "indicted": "occurrence", "convicted": "occurrence", "acquitted": "occurrence", "arrested": "occurrence", "fired": "occurrence", "removed": "occurrence",
}
# Words after a form of `be` that make a threshold, and nouns that make an occurrence.
COMPARING = ["above", "below", "over", "under", "less", "more", "greater", "fewer", "higher", "lower", "at least", "at most", "between", "than"]
EVENTS = ["shutdown", "recession", "default", "crisis", "collapse", "war", "invasion", "attack", "strike", "conflict", "impeachment", "resignation", "election", "coup", "pandemic", "outbreak", "emergency", "disaster"]
# Outcome type by keyword, in the order of trial.
OUTCOMES = {"win": "WIN", "elected": "WIN", "majority": "MAJORITY", "control": "CONTROL", "nominate": "NOMINATION", "nominee": "NOMINATION", "nomination": "NOMINATION", "run": "CANDIDACY", "announce": "CANDIDACY", "candidate": "CANDIDACY", "resign": "RESIGN", "impeach": "IMPEACH", "convict": "CONVICT", "confirm": "CONFIRM", "appoint": "APPOINT", "remain": "REMAIN"}
# Office by name.
OFFICES = {
    "president": "PRES", "presidential": "PRES", "presidency": "PRES", "potus": "PRES", "vice president": "VP", "vice-president": "VP", "vp": "VP", "veep": "VP", "governor": "GOV", "gubernatorial": "GOV", "governorship": "GOV", "mayor": "MAYOR", "mayoral": "MAYOR",
    "prime minister": "PM", "pm": "PM", "premier": "PM", "chancellor": "CHAN", "senate": "SEN", "senator": "SEN", "senatorial": "SEN", "house": "HOUSE", "house of representatives": "HOUSE", "congressman": "HOUSE", "congresswoman": "HOUSE", "representative": "HOUSE",
    "congress": "CONGRESS", "congressional": "CONGRESS", "parliament": "PARL", "parliamentary": "PARL", "mp": "PARL", "assembly": "ASSEMBLY", "state assembly": "ASSEMBLY", "party leader": "PARTY_LEADER", "party chair": "PARTY_CHAIR", "party chairman": "PARTY_CHAIR", "dnc chair": "DNC_CHAIR", "rnc chair": "RNC_CHAIR",
    "supreme court": "SCOTUS", "scotus": "SCOTUS", "chief justice": "CHIEF_JUSTICE", "justice": "JUSTICE", "secretary of state": "SEC_STATE", "secretary of defense": "SEC_DEF", "secretary of treasury": "SEC_TREAS", "attorney general": "AG",
    "fed chair": "FED_CHAIR", "federal reserve chair": "FED_CHAIR", "fed chairman": "FED_CHAIR", "ecb president": "ECB_PRES",
}
# Party by name.
PARTIES = {
    "republican": "GOP", "republicans": "GOP", "gop": "GOP", "rep": "GOP", "democrat": "DEM", "democrats": "DEM", "democratic": "DEM", "dem": "DEM", "dems": "DEM", "independent": "IND", "independents": "IND", "ind": "IND", "libertarian": "LIB", "libertarians": "LIB", "green": "GREEN", "green party": "GREEN",
    "conservative": "CON", "conservatives": "CON", "tory": "CON", "tories": "CON", "labour": "LAB", "labor": "LAB", "liberal democrat": "LIBDEM", "liberal democrats": "LIBDEM", "lib dem": "LIBDEM", "lib dems": "LIBDEM", "snp": "SNP", "scottish national party": "SNP",
    "liberal": "LIB", "liberals": "LIB", "conservative party": "CON", "ndp": "NDP", "new democratic party": "NDP", "bloc": "BLOC", "bloc quebecois": "BLOC",
    "christian democratic": "CDU", "christian democrats": "CDU", "cdu": "CDU", "cdu/csu": "CDU", "csu": "CDU", "social democratic": "SPD", "social democrats": "SPD", "spd": "SPD", "afd": "AFD", "alternative for germany": "AFD", "greens": "GREEN", "die grunen": "GREEN", "grune": "GREEN", "free democratic": "FDP", "fdp": "FDP",
    "hoyre": "HOYRE", "arbeiderpartiet": "AP", "labour party": "LAB", "fremskrittspartiet": "FRP", "frp": "FRP", "progress party": "FRP", "senterpartiet": "SP", "centre party": "SP", "kristelig folkeparti": "KRF", "krf": "KRF",
    "en marche": "LREM", "la republique en marche": "LREM", "renaissance": "LREM", "rassemblement national": "RN", "national rally": "RN", "front national": "RN", "les republicains": "LR", "the republicans": "LR",
    "fratelli d'italia": "FDI", "brothers of italy": "FDI", "lega": "LEGA", "lega nord": "LEGA", "forza italia": "FI", "partito democratico": "PD", "pd": "PD", "movimento 5 stelle": "M5S", "five star": "M5S", "m5s": "M5S",
    "partido popular": "PP", "pp": "PP", "psoe": "PSOE", "partido socialista": "PSOE", "vox": "VOX", "podemos": "POD", "vvd": "VVD", "pvv": "PVV", "partij voor de vrijheid": "PVV", "d66": "D66", "cda": "CDA", "labor party": "ALP", "australian labor": "ALP", "alp": "ALP", "liberal party": "LPA",
    "left": "LEFT", "right": "RIGHT", "center": "CENTER", "centre": "CENTER",
}
# Institution by name.
ACTORS = {
    "federal reserve": "FED", "fed": "FED", "fomc": "FED", "ecb": "ECB", "european central bank": "ECB", "bank of england": "BOE", "boe": "BOE", "bank of japan": "BOJ", "boj": "BOJ", "people's bank of china": "PBOC", "pboc": "PBOC", "bank of canada": "BOC", "boc": "BOC", "reserve bank of australia": "RBA", "rba": "RBA", "bank of korea": "BOK", "bok": "BOK", "bank of russia": "CBR", "cbr": "CBR", "reserve bank of new zealand": "RBNZ", "rbnz": "RBNZ",
    "white house": "WH", "congress": "CONGRESS", "senate": "SENATE", "house": "HOUSE", "supreme court": "SCOTUS", "scotus": "SCOTUS", "doj": "DOJ", "department of justice": "DOJ", "sec": "SEC", "securities and exchange commission": "SEC", "ftc": "FTC", "federal trade commission": "FTC", "fda": "FDA", "food and drug administration": "FDA", "epa": "EPA", "environmental protection agency": "EPA", "treasury": "TREAS", "treasury department": "TREAS",
    "un": "UN", "united nations": "UN", "nato": "NATO", "eu": "EU", "european union": "EU", "imf": "IMF", "international monetary fund": "IMF", "world bank": "WB", "world health organization": "WHO", "wto": "WTO", "world trade organization": "WTO", "appeals court": "APPEALS", "circuit": "APPEALS", "district court": "DISTRICT", "fcc": "FCC",
}
# Measure by name.
METRICS = {
    "gdp": "GDP", "gross domestic product": "GDP", "inflation": "INFLATION", "cpi": "CPI", "consumer price index": "CPI", "unemployment": "UNEMPLOYMENT", "unemployment rate": "UNEMPLOYMENT", "jobs": "JOBS", "nonfarm payrolls": "NFP", "interest rate": "RATE", "interest rates": "RATE", "fed funds rate": "FFR", "federal funds rate": "FFR",
    "s&p": "SPX", "s&p 500": "SPX", "sp500": "SPX", "dow": "DJIA", "dow jones": "DJIA", "nasdaq": "NDX", "bitcoin": "BTC", "btc": "BTC", "ethereum": "ETH", "eth": "ETH", "approval rating": "APPROVAL", "approval": "APPROVAL", "favorability": "FAVORABILITY", "polling": "POLL", "polls": "POLL",
}
# Scopes that are no state of the United States, cities first.
CITY_SCOPES = {"new york city": "NYC", "nyc": "NYC", "los angeles": "LA", "chicago": "CHICAGO", "houston": "HOUSTON", "philadelphia": "PHILA", "phoenix": "PHOENIX", "san antonio": "SAN_ANTONIO", "san diego": "SAN_DIEGO", "dallas": "DALLAS", "san francisco": "SF", "austin": "AUSTIN", "seattle": "SEATTLE", "denver": "DENVER", "boston": "BOSTON", "atlanta": "ATLANTA", "miami": "MIAMI", "detroit": "DETROIT", "oakland": "OAKLAND"}
REGION_SCOPES = {"ontario": "ON", "quebec": "QC", "british columbia": "BC", "alberta": "AB", "manitoba": "MB", "saskatchewan": "SK", "nova scotia": "NS", "new brunswick": "NB", "london": "LONDON", "scotland": "SCOTLAND", "wales": "WALES", "northern ireland": "NI", "federal": "FEDERAL", "national": "NATIONAL"}
# Other names of countries, and names of their people that no rule gives.
COUNTRY_NAMES = {
    "usa": "US", "u.s": "US", "u.s.a": "US", "america": "US", "american": "US", "americans": "US", "uk": "GB", "u.k": "GB", "britain": "GB", "great britain": "GB", "england": "GB", "british": "GB", "prc": "CN", "roc": "TW", "dprk": "KP", "drc": "CD", "uae": "AE", "holland": "NL", "burma": "MM", "czechia": "CZ", "ivory coast": "CI", "cote d'ivoire": "CI", "republic of georgia": "GE", "tbilisi": "GE", "turkey": "TR",
    "french": "FR", "german": "DE", "germans": "DE", "spanish": "ES", "dutch": "NL", "belgian": "BE", "polish": "PL", "chinese": "CN", "korean": "KR", "koreans": "KR", "turkish": "TR", "irish": "IE", "norwegian": "NO", "danish": "DK", "finnish": "FI", "greek": "GR", "hungarian": "HU", "filipino": "PH", "thai": "TH", "saudi": "SA", "emirati": "AE", "burmese": "MM", "moroccan": "MA", "ivorian": "CI", "congolese": "CD", "maltese": "MT", "cypriot": "CY", "montenegrin": "ME", "kosovar": "XK", "kiwi": "NZ",
    "swedish": "SE", "swiss": "CH", "portuguese": "PT", "peruvian": "PE", "czech": "CZ", "lebanese": "LB", "dominican": "DO", "afghan": "AF", "south korea": "KR", "north korea": "KP", "russia": "RU", "syria": "SY", "vietnam": "VN", "palestine": "PS",
}
#: Names of countries that are as often something else.
AMBIGUOUS = {"georgia", "jordan", "chad", "guinea", "us"}


def first_of(text: Column, table: dict[str, str]) -> Column:
    """The code of the entry that stands first in a lower-case text, the longest of those that begin there; null if none does.  One pattern for the whole table."""
    names = "|".join(re.escape(n).replace("\\ ", " ") for n in sorted(table, key=lambda n: (-len(n), n)))
    hit = F.regexp_extract(text, rf"(?<![a-z0-9])({names})(?![a-z0-9])", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), hit)


def verb_forms() -> dict[str, str]:
    """Frame type by every form of the verbs: the irregular ones, and those made by rule."""
    out = {form: VERBS[verb] for form, verb in IRREGULAR.items()}
    for verb, kind in VERBS.items():
        stem = verb[:-1] if verb.endswith("e") else verb
        third = f"{verb}es" if verb.endswith(("s", "h")) else f"{verb[:-1]}ies" if verb.endswith("fy") else f"{verb}s"
        past = f"{verb[:-1]}ied" if verb.endswith("fy") else f"{stem}ed"
        for form in (verb, third, past, f"{stem}ing"):
            out.setdefault(form, kind)
    return out


def countries(spark: SparkSession) -> dict[str, str]:
    """ISO code by the lower-case name of a country or its people: the names that Java's locale data has, forms made from them by rule, and the fixed ones."""
    locale = spark._jvm.java.util.Locale
    names = {}
    for code in locale.getISOCountries():
        name = locale("", code).getDisplayCountry(locale.ENGLISH).lower()
        plain = name.translate(str.maketrans("áâãäåçéêèëíîïñóôöõúûüʼ’", "aaaaaceeeeiiinoooouuu''"))
        names[plain.replace(" & ", " and ")] = code
    out = dict(COUNTRY_NAMES)
    for n, code in names.items():
        out.setdefault(n, code)
    endings = [("", "n"), ("", "ian"), ("", "ese"), ("", "i"), ("", "an"), ("a", "ian"), ("e", "ian"), ("y", "ian"), ("o", "an"), ("a", "e")]
    for cut, add in endings:
        for n, code in names.items():
            if " " not in n and n.endswith(cut):
                out.setdefault(n[: len(n) - len(cut)] + add, code)
    return {n: c for n, c in out.items() if n not in AMBIGUOUS and n not in {s.lower() for s in STATE_NAMES}}


def country_of(texts: DataFrame, text: str) -> DataFrame:
    """texts (distinct) with `country`: the first one named, the longest of those that begin there.  Runs of up to three words meet the broadcast dictionary, which has some two thousand names."""
    spark = texts.sparkSession
    table = spark.createDataFrame([(n, c) for n, c in sorted(countries(spark).items())] + [("US", "US")], "phrase string, iso string")
    words = F.transform(F.regexp_extract_all(fold(F.col(text)), F.lit(r"([A-Za-z.'-]+)"), F.lit(1)), lambda w: F.regexp_replace(w, r"('s|[.'-]+)$", ""))
    # `us` in lower case is a pronoun
    words = F.transform(words, lambda w: F.when(w == "US", w).otherwise(F.lower(w)))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(i.alias("at"), (-n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase")))))
    found = texts.select(text, F.inline(runs)).join(F.broadcast(table), "phrase").groupBy(text).agg(F.min_by("iso", F.struct("at", "n")).alias("country"))
    return texts.join(found, text, "left")
