"""Subjects of questions, for leaving out those that are not political before anything costly reads them."""

# Words that keep a question, and the patterns that leave one out with their reasons, in the order of trial.  All without regard to case.
POLITICAL_WORDS = [
    "Trump", "Biden", "Obama", "Clinton", "election", "congress", "senate", "parliament", "legislation", "law", "regulation", "tariff", "sanction", "treaty",
    "vote", "governor", "mayor", "president", "minister", "policy", "government", "federal", "DOJ", "FBI", "CIA", "NATO", "UN", "EU", "White House", "Capitol",
    "Supreme Court", "executive order", "cabinet", "nomination", "impeach", "Republican", "Democrat", "GOP", "DNC", "RNC", "primary", "caucus", "ballot",
    "referendum", "attend", "speech", "address", "testimony", "hearing", "committee", "investigation", "ban", "restriction", "mandate", "stimulus", "deficit",
    "debt ceiling", "shutdown", "ambassador", "diplomat", "summit", "ceasefire", "invasion", "military", "defense", "immigration", "border", "asylum",
    "deportation", "visa", "citizenship",
]
NOT_POLITICAL = [
    (r"\b(NFL|NBA|NHL|MLB|MLS|UFC|WWE|F1|NASCAR|PGA|ATP|WTA)\b", "Sports league"),
    (r"\b(Super Bowl|World Series|Stanley Cup|NBA Finals|World Cup|Champions League)\b", "Sports championship"),
    (r"\b(Premier League|La Liga|Serie A|Bundesliga|Ligue 1|Eredivisie|MLS Cup)\b", "Soccer league"),
    (r"\b(win|won)\s+the\s+\d{4}\s+(World Series|Super Bowl|Stanley Cup|NBA Finals)\b", "Sports championship"),
    (r"\bWorld Baseball Classic\b", "Sports championship"),
    (r"\b(EPL|Premier League)\b.*\b(standings|finish|relegated)\b", "Soccer standings"),
    (r"\b(Masters tournament|PGA Championship|US Open golf|Open Championship|Ryder Cup)\b", "Golf tournament"),
    (r"\bAll[ -]Star\b.*\b(selected|game|selection)\b", "Sports All-Star"),
    (r"\bpoint spread\b", "Sports betting"),
    (r"\bover/under\b", "Sports betting"),
    (r"\bmoneyline\b", "Sports betting"),
    (r"\btop\s+(\w+\s+)?goal\s*scorer\b", "Sports stats"),
    (r"\btop\s+scorer\b", "Sports stats"),
    (r"\b(touchdown|home run|goal|assist)s?\s+record\b", "Sports stats"),
    (r"\bMVP\s+(award|winner|vote)\b", "Sports award"),
    (r"\bHall of Fame\b", "Sports"),
    (r"\bNaismith\b", "College basketball award"),
    (r"\bHeisman\b", "College football award"),
    (r"\b(Freshman|Player) of the Year\b", "Sports award"),
    (r"\bAll-American\b", "Sports award"),
    (r"\b(be traded|traded by).*season\b", "Sports trade"),
    (r"\b(not be traded|be traded)\?", "Sports trade"),
    (r"\bvs\b.*Winner\?", "Sports matchup"),
    (r"\bnext\b.*\bHead Coach\b", "Sports coaching"),
    (r"\b(Raiders|Chiefs|Cowboys|Eagles|Packers|Bears|Lions|49ers|Patriots|Jets|Dolphins|Bills|Broncos|Chargers|Bengals|Browns|Steelers|Ravens|Titans|Colts|Texans|Jaguars|Saints|Buccaneers|Falcons|Panthers|Seahawks|Rams|Cardinals|Giants|Commanders|Vikings)\b.*\b(coach|trade|sign|draft)\b", "NFL team"),
    (r"\btraded to the (Jets|Raiders|Chiefs|Cowboys|Eagles|Packers|Bears|Lions|49ers|Patriots)\b", "Sports trade"),
    (r"\bwin the (most|second|third)\s+(most\s+)?(gold\s+)?medals?\b", "Olympics sports"),
    (r"\b(gold|silver|bronze)\s+medal\s+at\s+the\b", "Olympics sports"),
    (r"\bmedal points\b", "Olympics sports"),
    (r"\bIce Hockey\s+(gold|silver|bronze)\b", "Olympics sports"),
    (r"\bFields Medal\b", "Academic award"),
    (r"\bFIDE\b", "Chess"),
    (r"\b(LCS|LPL|LEC|VCT|CDL|PGL|ESL|IEM|Worlds|Major)\b.*\b(win|qualify|champion)\b", "Esports"),
    (r"\b(esports|e-sports)\b", "Esports"),
    (r"\b(CS2|CSGO|CS:GO|Valorant|League of Legends|Dota|Dota2|Fortnite|Apex Legends)\b", "Esports game"),
    (r"\b(Fnatic|Cloud9|T1|G2|Team Liquid|NRG|Sentinels|100 Thieves|OpTic|FaZe|Evil Geniuses)\b", "Esports team"),
    (r"\bwin\s+(the\s+)?(LCS|LPL|LEC|VCT|CDL|PGL|ESL|IEM)\b", "Esports league"),
    (r"\bqualify for (Worlds|playoffs|the Major)\b", "Esports"),
    (r"\b(Bitcoin|BTC|Ethereum|ETH|Solana|SOL|XRP|Dogecoin|DOGE)\b.*\b(price|above|below|hit|reach)\s*\$", "Crypto price"),
    (r"\$\d+k\b.*\b(Bitcoin|BTC|ETH)\b", "Crypto price"),
    (r"\b(Bitcoin|BTC)\s*(dominance|volatility)\b", "Crypto market"),
    (r"\b(Bitcoin|Ethereum|BTC|ETH)\b.*\b(daily candle|candle change)\b", "Crypto price"),
    (r"\bETF Flows\b", "Crypto ETF"),
    (r"\bGwei\b", "Crypto technical"),
    (r"\b(AAPL|TSLA|NVDA|GOOGL|MSFT|AMZN|META|NFLX|AMD)\b.*\b(stock|price|above|below)\b", "Stock price"),
    (r"\$[A-Z]{1,5}\s+(stock|share|price)\s+(above|below|hit)", "Stock price"),
    (r"\bS&P 500\b.*\b(hit \$|LOW|HIGH|percentage change)\b", "Stock price"),
    (r"\b(Magnificent 7|top performing)\b.*\bcompany\b", "Stock performance"),
    (r"\btrillionaire\b", "Wealth ranking"),
    (r"\b(Gold|Silver|Copper|Crude Oil|Natural Gas|Platinum|Palladium)\s*\([A-Z]{1,2}\)\s*settle", "Commodity price"),
    (r"\b(WTI|Brent)\s*(crude|oil)?\s*(price|above|below|settle)", "Commodity price"),
    (r"\b(Grammy|Oscar|Emmy|BAFTA|Golden Globe|Tony Award|SAG Award)\b", "Entertainment award"),
    (r"\b(Best Picture|Best Actor|Best Actress|Best Director|Best Film)\b.*\b(award|win|nomination)\b", "Entertainment award"),
    (r"\bbox office\b", "Movies"),
    (r"\btop grossing (movie|film)\b", "Movies"),
    (r"\bBillboard\s+(Hot|100|200|chart)\b", "Music charts"),
    (r"\brelease an? (new\s+)?(album|single)\b", "Music"),
    (r"\b(tour|concert)\s+(announce|dates|start)\b", "Music"),
    (r"\bBig Brother\b(?!.*\b(China|surveillance|Orwell)\b)", "Reality TV"),
    (r"\bLove Island\b", "Reality TV"),
    (r"\bBachelor(ette)?\b", "Reality TV"),
    (r"\bSurvivor\b.*\b(winner|win|voted|eliminated|immunity)\b", "Reality TV"),
    (r"\$\d+[BT]\+?\s*valuation", "Tech valuation"),
    (r"\b(OpenAI|Anthropic|xAI)\b.*\$\d+[BT]", "Tech valuation"),
    (r"\b(iPhone|iPad|Galaxy|Pixel)\s*\d+\s*(release|launch|announce)", "Tech product"),
    (r"\bbest AI model\b", "AI ranking"),
    (r"\b(second|third)-?best AI\b", "AI ranking"),
    (r"\b(FrontierMath|Humanity\'s Last Exam)\b", "AI benchmark"),
    (r"\b(GPT|Gemini|Claude)\b.*\b(score|benchmark)\b", "AI benchmark"),
    (r"\b(hit|reach|pass)\s*\d+\s*(Million|M|K)?\s*(subscribers|followers)\b", "Social media metrics"),
    (r"\bsubscriber count\b", "Social media metrics"),
    (r"\bmillion (subscribers|followers)\b", "Social media metrics"),
    (r"\b(pregnant|pregnancy|engaged|married|divorce|dating|baby)\b.*\b(202[4-9]|203\d)\b", "Celebrity gossip"),
    (r"\bconfirmed pregnant\b", "Celebrity gossip"),
    (r"\binches of (rain|snow)\b", "Weather"),
    (r"\b(temperature|rainfall|snowfall)\s+(in|on|for|at)\s+[A-Z]", "Weather"),
    (r"\bGTA\s*(VI|6|VII|7)\b(?!.*\b(before|ceasefire|invasion|war|president|Trump)\b)", "Video game"),
    (r"\bvideo game\s+(release|sales|launch)\b", "Video game"),
    (r"\b(Pokemon|Pokémon)\s+card\b", "Collectibles"),
    (r"\bCharizard\b", "Collectibles"),
    (r"\btrading card\b.*\b(price|sale|value)\b", "Collectibles"),
    (r"\b(Pop Mart|Labubu)\b", "Collectibles"),
    (r"\b(Elon|Musk)\b.*\btweet", "Tweet counts"),
    (r"\btweet\s+\d+.*times\b", "Tweet counts"),
    (r"\b\d+.*times.*tweet\b", "Tweet counts"),
    (r"\bbeat quarterly earnings\b", "Business metrics"),
    (r"\b(revenue|earnings)\s+(beat|miss|exceed)\b", "Business metrics"),
    (r"\bquarterly (revenue|earnings|results)\b", "Business metrics"),
    (r"\bTSA\s*(passengers?|checkpoint)\b", "TSA metrics"),
    (r"\bEurovision\b", "Eurovision"),
    (r"\bBallon d.Or\b", "Sports award"),
    (r"\bTiny Desk\b", "Entertainment"),
    (r"\bNPR Music\b", "Entertainment"),
    (r"\bGoogle.*Year in Search\b", "Entertainment"),
    (r"\bYear in Search.*Google\b", "Entertainment"),
    (r"\bDebate Bingo\b", "Entertainment"),
    (r"\b(median home value|rent grow|housing price)\b", "Real estate"),
    (r"\bcreative director\b.*\b(Versace|Gucci|Prada|Chanel|Dior)\b", "Fashion"),
    (r"\b#1 (Free )?App\b", "App ranking"),
    (r"\bMrBeast\b", "Influencer"),
    (r"\b(views|subscribers)\s+on\s+(a\s+)?(YouTube|MrBeast)\b", "Social media metrics"),
    (r"\b\d+m\s+views\b", "Social media metrics"),
    (r"\b(named|mentioned)\s+in\s+(the\s+)?(newly\s+)?released\s+Epstein\s+files?\b", "Celebrity gossip"),
    (r"\bEpstein\s+files?\b(?!.*(Trump|Clinton|DOJ|FBI|judge|court|congress))", "Celebrity gossip"),
    (r"\b(unfollow|dating|relationship)\b.*\b(Grimes|Brady|Belichick)\b", "Celebrity gossip"),
    (r"\bearthquakes?\b.*\bmagnitude\b", "Natural disaster"),
    (r"\b(volcanic|VEI)\b.*\beruption", "Natural disaster"),
    (r"\btornadoes?\b.*\boccur\b", "Natural disaster"),
    (r"\brank\b.*\bnames\b.*\bSSA\b", "Baby names"),
    (r"\bCanada.s?\b.*\bpopulation\b", "Demographics"),
    (r"\begg prices\b", "Commodity prices"),
    (r"\b(Discord|Cloudflare)\b.*\b(incident|outage)\b", "Tech incident"),
    (r"\b(Bitcoin|ETH|Ethereum)\b.*\b(ATH|all.time.high)\b", "Crypto price"),
    (r"\bcrypto\b.*\bliquidation\b", "Crypto market"),
    (r"\bOpenAI\b.*\bacquired\b", "Tech acquisition"),
    (r"\bbuy\b.*\bsports team\b", "Sports business"),
    (r"\bS&P 500\b.*\bgain\b.*\bday\b", "Stock market"),
    (r"\bsay\b.*\bduring\b.*\bearnings call\b", "Corporate earnings call"),
    (r"\b(university|commencement|graduation)\b.*\bcancel", "Education"),
    (r"\brelease\b.*\b(song|album)\b.*\b202[5-9]\b", "Music release"),
    (r"\bat\b.*\bWinner\?\s*$", "Sports matchup"),
    (r"^yes [A-Z][a-z]+ [A-Z][a-z]+,yes", "Fantasy sports lineup"),
    (r"\bDJ Mag\b.*\bTop\s*\d+\b", "DJ rankings"),
    (r"\b(Coachella|Lollapalooza|Glastonbury|Bonnaroo)\b.*\bHeadliner\b", "Music festival"),
    (r"\b#1\s+(album|song|hit|single)\b", "Music charts"),
    (r"\btop\s+\d+\s+(song|album|hit)\b", "Music charts"),
    (r"\bBillboard\b.*\b(Hot 100|chart|#1)\b", "Music charts"),
    (r"\bSingle.s Inferno\b", "Reality TV"),
    (r"\bLove Island\b.*\b(winner|couple|finale)\b", "Reality TV"),
    (r"\b(Bachelor|Bachelorette)\b.*\b(winner|finale|rose)\b", "Reality TV"),
    (r"\b(separate|divorce|split)\b.*\b202[5-9]\b", "Celebrity gossip"),
    (r"\bbar exam\b", "Personal achievement"),
]
