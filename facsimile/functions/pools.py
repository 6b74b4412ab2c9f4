"""Word pools for fake values (own lists, not from any faker library)."""

# Pools used by the fake text, email, name and address generators.
WORDS = [
    "account", "action", "after", "again", "agent", "almost", "amount", "answer", "area", "around",
    "bank", "before", "better", "beyond", "board", "bring", "budget", "build", "call", "care",
    "carry", "case", "center", "change", "check", "choice", "city", "clear", "close", "color",
    "common", "cost", "country", "course", "data", "deal", "decide", "detail", "develop", "early",
    "east", "effort", "energy", "event", "every", "field", "figure", "final", "focus", "force",
    "form", "future", "garden", "general", "green", "group", "growth", "happen", "health", "history",
    "house", "idea", "image", "index", "issue", "item", "join", "keep", "kind", "labor",
    "large", "later", "level", "light", "local", "major", "market", "matter", "measure", "method",
    "model", "money", "month", "moment", "nature", "network", "north", "number", "offer", "office",
    "order", "paper", "party", "people", "period", "place", "plan", "point", "policy", "power",
    "price", "process", "product", "public", "quality", "question", "range", "rate", "reach", "record",
    "region", "report", "result", "river", "route", "sample", "season", "series", "service", "share",
    "signal", "simple", "social", "source", "south", "space", "stage", "state", "store", "street",
    "study", "style", "system", "table", "theory", "track", "trade", "travel", "truth", "value",
    "voice", "water", "west", "window", "winter", "world", "write", "yellow", "young", "zone",
]
FIRST_NAMES = [
    "Alex", "Amara", "Ben", "Carla", "Dmitri", "Elena", "Farah", "Gabriel", "Hana", "Ivan",
    "Jonas", "Kira", "Liam", "Maya", "Nils", "Olga", "Pablo", "Quinn", "Rosa", "Samir",
    "Tara", "Uma", "Victor", "Wen", "Yara", "Zane",
]
LAST_NAMES = [
    "Abbott", "Baker", "Castillo", "Dubois", "Eriksen", "Fischer", "Garcia", "Hoffman", "Ito", "Jensen",
    "Kowalski", "Larsen", "Moreau", "Nakamura", "Okafor", "Petrov", "Quist", "Rossi", "Silva", "Tanaka",
    "Ueda", "Varga", "Weber", "Xu", "Yilmaz", "Zimmer",
]
EMAIL_DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "corp.example.org"]
STREET_NAMES = ["Oak", "Maple", "Cedar", "Pine", "Elm", "Birch", "Willow", "Lake", "Hill", "Park", "River", "Sunset"]
STREET_SUFFIXES = ["Street", "Avenue", "Road", "Lane", "Drive", "Court", "Way", "Place"]
CITIES = ["Springfield", "Riverton", "Lakeside", "Fairview", "Greenville", "Madison", "Georgetown", "Franklin", "Clinton", "Salem"]
STATES = ["AL", "CA", "CO", "FL", "GA", "IL", "MA", "NY", "OH", "OR", "TX", "WA"]
