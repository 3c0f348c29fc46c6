"""Dimension values: metrics, aliases, organisations, units, sites, topics, patterns.

Everything here is a parameter with a default. Callers with another vocabulary pass their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values (must equal the established vocabulary) -----------------------------------------

# (metric code, display name, default unit)
METRICS = [
    ("COAL_PRODUCTION", "Coal Production", "MT"),
    ("PRODUCTION_TARGET", "Production Target", "MT"),
    ("COAL_OFFTAKE", "Coal Dispatch / Offtake", "MT"),
    ("DISPATCH_TARGET", "Dispatch Target", "MT"),
    ("GEOLOGICAL_RESERVES", "Geological Reserves", "MT"),
    ("PROVED_RESERVE", "Proved Reserve", "MT"),
    ("INDICATED_RESERVE", "Indicated Reserve", "MT"),
    ("INFERRED_RESERVE", "Inferred Reserve", "MT"),
    ("OVERBURDEN_REMOVAL", "Overburden Removal", "Mm3"),
    ("OB_TARGET", "Overburden Target", "Mm3"),
    ("DRILLING", "Drilling", "m"),
    ("EXPLORATION_BOREHOLES", "Exploration Boreholes", "count"),
    ("BOREHOLE_COUNT", "Boreholes Drilled", "count"),
    ("EXPLORATION_AREA", "Exploration Area", "sq km"),
    ("COAL_STOCK", "Coal Stock", "MT"),
    ("MINE_AREA", "Mine Area", "ha"),
    ("STRIPPING_RATIO", "Stripping Ratio", "m3/t"),
    ("TARGET_ACHIEVEMENT", "Target Achievement", "%"),
    ("CAPITAL_EXPENDITURE", "Capital Expenditure", "INR Cr"),
    ("MANPOWER", "Manpower", "count"),
    ("ENVIRONMENTAL_CLEARANCE_AREA", "Environmental Clearance Area", "ha"),
    ("ENVIRONMENTAL_CLEARANCE", "Environmental Clearance Area", "ha"),
    ("WASHERY_CAPACITY", "Washery Capacity", "MTPA"),
    ("COAL_QUALITY", "Coal Quality", "kcal/kg"),
    ("GCV_QUALITY", "Coal Quality (GCV)", "kcal/kg"),
    ("COAL_QUALITY_GCV", "Coal Quality (GCV)", "kcal/kg"),
    ("COAL_QUALITY_ASH", "Coal Quality (Ash)", "%"),
    ("WASHED_COAL_YIELD", "Washed Coal Yield", "%"),
    ("SEAM_THICKNESS", "Seam Thickness", "m"),
    ("DEPTH", "Depth", "m"),
    ("REVENUE", "Revenue", "INR Cr"),
    ("PROFIT", "Profit / Loss", "INR Cr"),
    ("ROYALTY", "Royalty", "INR Cr"),
    ("SPECIFIC_POWER_CONSUMPTION", "Specific Power Consumption", "kWh/t"),
]

# old metric code -> current metric code
LEGACY_CODES = {
    "COAL_DISPATCH": "COAL_OFFTAKE",
    "GEOLOGICAL_RESERVE": "GEOLOGICAL_RESERVES",
    "COAL_QUALITY_GCV": "GCV_QUALITY",
}

# metric code -> lower-case alias texts
METRIC_ALIASES = {
    "COAL_PRODUCTION": [
        "coal production", "actual production", "production", "raw coal production", "coal output",
        "output", "coal extraction", "extraction", "coal raised",
    ],
    "PRODUCTION_TARGET": [
        "production target", "target production", "planned production", "target", "annual target",
    ],
    "COAL_OFFTAKE": [
        "coal dispatch", "dispatch", "offtake", "coal offtake", "despatches", "dispatches",
        "coal despatches",
    ],
    "DISPATCH_TARGET": ["dispatch target", "target dispatch", "planned dispatch"],
    "GEOLOGICAL_RESERVES": [
        "geological reserve", "geological reserves", "coal reserve", "coal reserves",
        "coal resource", "resources", "total reserve",
    ],
    "PROVED_RESERVE": ["proved reserve", "proved reserves"],
    "INDICATED_RESERVE": ["indicated reserve"],
    "INFERRED_RESERVE": ["inferred reserve"],
    "OVERBURDEN_REMOVAL": [
        "overburden", "overburden removal", "ob removal", "ob", "o/b", "overburden excavation",
        "waste removal",
    ],
    "OB_TARGET": ["ob target", "overburden target"],
    "DRILLING": [
        "drilling", "drilled metres", "drilled meters", "meterage", "core drilling",
        "total drilling", "drilling meterage",
    ],
    "EXPLORATION_BOREHOLES": [
        "exploration boreholes", "boreholes", "boreholes drilled", "number of boreholes",
    ],
    "COAL_STOCK": ["coal stock", "stock", "pit head stock", "closing stock"],
    "MINE_AREA": ["mine area", "leasehold area", "total area"],
    "STRIPPING_RATIO": ["stripping ratio", "sr", "s/r"],
    "TARGET_ACHIEVEMENT": ["target achievement", "achievement", "% achievement", "achievement %"],
    "CAPITAL_EXPENDITURE": ["capex", "capital expenditure"],
    "REVENUE": ["revenue", "turnover"],
    "PROFIT": ["profit", "loss"],
    "ROYALTY": ["royalty"],
    "MANPOWER": ["manpower", "employees", "workforce", "total manpower"],
    "ENVIRONMENTAL_CLEARANCE_AREA": ["environmental clearance area", "forest clearance", "ec area"],
    "ENVIRONMENTAL_CLEARANCE": ["environmental clearance"],
    "WASHERY_CAPACITY": ["washery capacity", "coal washery"],
    "COAL_QUALITY": ["coal quality"],
    "GCV_QUALITY": ["gcv", "gross calorific value"],
    "COAL_QUALITY_ASH": ["ash"],
    "SEAM_THICKNESS": ["seam thickness", "thickness"],
    "DEPTH": ["depth", "mine depth"],
    "WASHED_COAL_YIELD": ["washed coal yield"],
    "SPECIFIC_POWER_CONSUMPTION": ["specific power consumption", "spc"],
}

# (alias, organisation code, full name)
ORGS = [
    ("cil", "CIL", "Coal India Limited"),
    ("coal india", "CIL", "Coal India Limited"),
    ("coal india limited", "CIL", "Coal India Limited"),
    ("ecl", "ECL", "Eastern Coalfields Limited"),
    ("eastern coalfields", "ECL", "Eastern Coalfields Limited"),
    ("eastern coalfields limited", "ECL", "Eastern Coalfields Limited"),
    ("bccl", "BCCL", "Bharat Coking Coal Limited"),
    ("bharat coking coal", "BCCL", "Bharat Coking Coal Limited"),
    ("bharat coking coal limited", "BCCL", "Bharat Coking Coal Limited"),
    ("ccl", "CCL", "Central Coalfields Limited"),
    ("central coalfields", "CCL", "Central Coalfields Limited"),
    ("central coalfields limited", "CCL", "Central Coalfields Limited"),
    ("wcl", "WCL", "Western Coalfields Limited"),
    ("western coalfields", "WCL", "Western Coalfields Limited"),
    ("western coalfields limited", "WCL", "Western Coalfields Limited"),
    ("secl", "SECL", "South Eastern Coalfields Limited"),
    ("south eastern coalfields", "SECL", "South Eastern Coalfields Limited"),
    ("south eastern coalfields limited", "SECL", "South Eastern Coalfields Limited"),
    ("ncl", "NCL", "Northern Coalfields Limited"),
    ("northern coalfields", "NCL", "Northern Coalfields Limited"),
    ("northern coalfields limited", "NCL", "Northern Coalfields Limited"),
    ("mcl", "MCL", "Mahanadi Coalfields Limited"),
    ("mahanadi coalfields", "MCL", "Mahanadi Coalfields Limited"),
    ("mahanadi coalfields limited", "MCL", "Mahanadi Coalfields Limited"),
    ("cmpdi", "CMPDI", "Central Mine Planning and Design Institute"),
    ("cmpdil", "CMPDI", "Central Mine Planning and Design Institute Limited"),
    ("central mine planning and design institute", "CMPDI",
     "Central Mine Planning and Design Institute"),
    ("nec", "NEC", "North Eastern Coalfields"),
    ("north eastern coalfields", "NEC", "North Eastern Coalfields"),
    ("moc", "MoC", "Ministry of Coal"),
    ("ministry of coal", "MoC", "Ministry of Coal"),
]
ORG_CODES = ["CIL", "ECL", "BCCL", "CCL", "WCL", "SECL", "NCL", "MCL", "CMPDI", "NEC", "MoC"]
# codes accepted as the owner of a table row
TABLE_ORG_CODES = ["CIL", "ECL", "BCCL", "CCL", "WCL", "SECL", "NCL", "MCL", "CMPDI"]
# organisation order used when a question names several
QUESTION_ORG_CODES = ["ECL", "BCCL", "CCL", "WCL", "SECL", "MCL", "NCL", "CMPDI", "CIL"]
COMPANIES = ["ECL", "BCCL", "CCL", "WCL", "SECL", "MCL", "NCL"]
GROUP_TOTALS = ["CIL", "COAL INDIA", "CONSOLIDATED"]

# site -> owning organisation
SITES = {
    "gevra": "SECL", "kusmunda": "SECL", "dipka": "SECL", "jayant": "NCL", "dudhichua": "NCL",
    "nigahi": "NCL", "amlohri": "NCL", "bhubaneswari": "MCL", "samaleswari": "MCL",
    "lakhanpur": "MCL", "kulda": "MCL", "belpahar": "MCL", "rajmahal": "ECL",
    "sonepur bazari": "ECL", "piparwar": "CCL", "ashok": "CCL", "amrapali": "CCL",
    "magadh": "CCL", "moonidih": "BCCL", "katras": "BCCL", "kusunda": "BCCL", "umrer": "WCL",
}

# (pattern, canonical unit); order matters, first hit wins
UNIT_PATTERNS = [
    (r"\b(m\.?t\.?|million\s+t(?:onne)?s?|mt)\b", "MT"),
    (r"\b(mtpa|mt\s*/\s*(?:year|yr|annum|pa))\b", "MTPA"),
    (r"\b(thou(?:sand)?\s+t(?:onne)?s?|000\s*t)\b", "000T"),
    (r"\b(t(?:onne)?s?)\b", "T"),
    (r"\b(m(?:etres?|eters?)?)\b(?!\s*t)", "m"),
    (r"\b(km|kilo\s*m(?:etres?|eters?)?)\b", "km"),
    (r"\b(mm\s*3|million\s*m\s*3|mcm)\b", "Mm3"),
    (r"\b(m\s*3)\b", "m3"),
    (r"\b(ha|hectares?)\b", "ha"),
    (r"\b(sq\.?\s*km|km\s*2)\b", "sq km"),
    (r"(%|\bper\s*cent(?:age)?\b)", "%"),
    (r"(\binr\s*cr|₹\s*cr(?:ore)?|\brs\.?\s*cr(?:ore)?|\bcrore(?:s)?\b)", "INR Cr"),
    (r"(\binr\s*lakh|\brs\.?\s*lakh\b|₹\s*lakh)", "INR Lakh"),
    (r"\b(kcal\s*/\s*kg|kcal/kg)\b", "kcal/kg"),
    (r"\b(m\s*3\s*/\s*t|m3/t|bcm/t)\b", "m3/t"),
    (r"\b(nos?\.?|numbers?|count)\b", "count"),
    (r"\b(bcm|billion\s*cubic\s*metres?)\b", "BCM"),
]

# canonical unit, allowed units, additive over entities, additive over time, may be summed,
# default aggregation
METRIC_SEMANTICS = {
    "COAL_PRODUCTION": (
        "MT", ["MT", "Mt", "Million Tonnes", "million tonnes", "Mn T", "mn t"],
        True, True, True, "SUM"),
    "COAL_OFFTAKE": ("MT", ["MT", "Mt", "Million Tonnes", "Mn T"], True, True, True, "SUM"),
    "PRODUCTION_TARGET": ("MT", ["MT", "Mt", "Million Tonnes"], False, False, True, "SUM"),
    "OVERBURDEN_REMOVAL": (
        "Mm3", ["Mm3", "BCM", "Mm³", "Million cubic metres", "MCM"], True, True, True, "SUM"),
    "DRILLING": ("m", ["m", "meters", "metres", "Meters"], True, True, True, "SUM"),
    "COAL_STOCK": ("MT", ["MT", "Mt", "Million Tonnes"], True, False, False, "LATEST"),
    "GCV": ("kcal/kg", ["kcal/kg", "kcal per kg"], False, False, False, "WAVG"),
    "GEOLOGICAL_RESERVES": ("MT", ["MT", "Mt", "Million Tonnes"], True, False, True, "SUM"),
    "CAPITAL_EXPENDITURE": (
        "INR Cr", ["INR Cr", "Cr", "Crores", "Rs Cr", "INR Crore"], True, True, True, "SUM"),
    "EXPLORATION_BOREHOLES": (
        "Count", ["Count", "Nos", "Number", "count"], True, True, True, "SUM"),
}
DEFAULT_UNIT = "units"

# topic -> lower-case keywords
TOPICS = {
    "Production Intelligence": [
        "coal", "production", "extraction", "opencast", "output", "achieved", "target",
        "dragline", "shovel"],
    "Geological Exploration": [
        "borehole", "coring", "strata", "seam", "geological", "cmpdi", "exploration", "lithology"],
    "Drilling & Coring": [
        "drilling", "meters", "exploratory", "rigs", "hydrostatic", "depth", "casing",
        "penetration"],
    "Coal Reserve Estimation": [
        "reserves", "proved", "indicated", "unfc", "resources", "measured", "in-situ",
        "estimation"],
    "Dispatch & Offtake": [
        "offtake", "dispatch", "rakes", "railways", "mgr", "fmc", "linkage", "power plants"],
    "Overburden & Stripping": [
        "overburden", "stripping", "bcm", "mm3", "ratio", "bench", "dumper", "waste"],
    "Mine Safety & Hazards": [
        "safety", "dgms", "hazard", "slope", "ventilation", "methane", "monitoring",
        "accident-free"],
    "Environmental Clearance": [
        "environmental", "clearance", "moef", "emissions", "plantation", "water treatment",
        "air quality"],
    "Land Acquisition & R&R": [
        "land", "acquisition", "cba", "possession", "rehabilitation", "resettlement",
        "compensation"],
    "Mine Planning & Design": [
        "planning", "design", "project report", "gradient", "optimization", "slope",
        "3d modeling"],
    "Coal Quality & Grading": [
        "quality", "gcv", "grade", "ash", "calorific", "moisture", "sampling", "third party"],
    "Coal Washeries": [
        "washery", "beneficiation", "yield", "coking coal", "clean coal", "rejects", "cyclone"],
    "Capital Expenditure (Capex)": [
        "capex", "capital expenditure", "procurement", "investment", "infrastructure",
        "machinery"],
    "Manpower & Productivity": [
        "manpower", "oms", "productivity", "manshift", "workforce", "safety training"],
    "Statutory Compliance": [
        "statutory", "regulations", "cmr", "parliamentary", "audit", "compliance",
        "inspection"],
}

# words that carry no meaning in a retrieval query
STOPWORDS = [
    "what", "which", "where", "when", "who", "whom", "how", "show", "tell", "give", "explain",
    "about", "the", "and", "for", "with", "from", "that", "this", "these", "those", "have", "has",
    "had", "are", "were", "been", "will", "would", "shall", "should", "can", "could", "may",
    "might", "please", "report", "document", "data", "figure", "figures", "metric",
]

# instruction-like phrases that are blanked before text is quoted
INJECTION_PATTERN = (
    r"\b(?:ignore\s+(?:previous|all|prior)\s+instructions?|system\s+override"
    r"|disregard\s+rules?|you\s+are\s+now|jailbreak)\b"
)

# one fact in running text: organisation, metric, number, unit, period
TEXT_FACT_PATTERN = (
    r"(?i)\b([A-Z]{3,5})?\s*(?:achieved|recorded|reported|produced|mined|drilled)?\s*"
    r"([a-zA-Z\s]{3,35}?)\s*(?:of|is|was|reached|totalling|stands at)?\s*"
    r"[:=]?\s*([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?)\s*"
    r"(MT|BCM|Lakh Tonnes|Million Tonnes|Tonnes|Mte|M\.T\.|m|Mm3|ha|Cr|INR Cr)?\b"
    r"(?:[^\n\.\;]*?(?:during|in|for)?\s*(FY\s*\d{4}[-–]\d{2,4}|\d{4}[-–]\d{2,4}|Q[1-4]\s*FY\d{2}))?"
)
TEXT_FACT_VERBS = ["achieved", "recorded", "reported", "produced", "mined", "drilled"]
# metrics whose values may look like a year
YEAR_LIKE_METRICS = ["DRILLING", "BOREHOLE_COUNT"]

# header words that give a column its role; the lists marked "part" match inside the header
ROLE_METRIC = ["metric", "parameter", "indicator", "activity", "item", "particulars"]
ROLE_VALUE = ["value", "actual", "figure", "qty", "quantity", "amount", "total"]
ROLE_UNIT = ["unit", "uom"]
ROLE_PERIOD_PART = ["period", "year", "fy", "financial year", "quarter", "month"]
ROLE_ORG_PART = ["subsidiary", "company", "organization", "org", "co"]
ROLE_SITE_PART = ["mine", "colliery", "project", "block", "area", "field"]
ROW_PERIOD_PART = ["period", "year", "quarter", "month", "fy"]
HEADER_WORDS = [
    "target", "actual", "production", "subsidiary", "mine", "period", "unit", "value", "sl",
    "s.no"]

# document category -> words, tested in this order
DOC_CATEGORIES = [
    ("ANNUAL_REPORT",
     ["annual report", "annual account", "director's report", "integrated annual report"]),
    ("PRODUCTION_REPORT",
     ["production", "offtake", "despatch", "overburden", "stripping ratio", "bcm", "raw coal"]),
    ("DRILLING_LOG", ["drill", "borehole", "coring", "lithology", "strata"]),
    ("GEOLOGICAL_REPORT",
     ["geological", "cmpdi report", "exploration", "coal reserve", "grade g1", "grade g"]),
    ("MINE_PLAN",
     ["mine plan", "mining plan", "environmental clearance", "project report", "mine closure"]),
    ("FINANCIAL_REPORT",
     ["financial", "balance sheet", "p&l", "profit and loss", "ebitda"]),
]
DEFAULT_DOC_CATEGORY = "GENERAL_REPORT"
FILENAME_CATEGORIES = [
    ("drill", "Drilling & Exploration"), ("prod", "Production Report"),
    ("dispatch", "Dispatch Statement"), ("geol", "Geological Assessment"),
    ("reserve", "Reserve Estimation"),
]
DEFAULT_FILENAME_CATEGORY = "General Mining Report"

# question-word stems -> (metric code, display name, unit); tested in this order
QUESTION_METRICS = [
    (["borehole"], "EXPLORATION_BOREHOLES"),
    (["drill", "drilling", "coring"], "DRILLING"),
    (["overburden", "obr", "stripping"], "OVERBURDEN_REMOVAL"),
    (["dispatch", "offtake", "rake"], "COAL_OFFTAKE"),
    (["reserve", "geological"], "GEOLOGICAL_RESERVES"),
    (["target"], "PRODUCTION_TARGET"),
    (["capex", "capital", "expenditure"], "CAPITAL_EXPENDITURE"),
    (["stock"], "COAL_STOCK"),
    (["production", "output", "mined", "extracted"], "COAL_PRODUCTION"),
]

# intent patterns, by label
INTENTS = {
    "GREETING": [
        r"^(?:hi|hello|hey|namaste|greetings|good\s+(?:morning|afternoon|evening))\b",
        r"^(?:hi|hello|hey)\s+(?:there|assistant|bot)\b",
    ],
    "HELP": [
        r"^\b(?:help|how\s+to\s+use|how\s+does\s+this\s+work|guide\s+me|usage\s+guide|how\s+to\s+ask)\b",
        r"\b(?:give\s+me\s+help|need\s+help|what\s+should\s+i\s+ask)\b",
    ],
    "CAPABILITY_QUERY": [
        r"\b(?:what\s+can\s+you\s+do|what\s+are\s+your\s+capabilities|your\s+features)\b",
        r"\b(?:system\s+capabilities|platform\s+overview)\b",
    ],
    "PARLIAMENTARY_QUERY": [
        r"\b(?:parliamentary|lok\s+sabha|rajya\s+sabha|starred\s+question|unstarred\s+question|pq\s+brief|parliament\s+query)\b",
        r"\bparliamentary\s+(?:reply|response|brief)\b",
    ],
    "FACT_VERIFICATION": [
        r"\bverify\s+claim\b",
        r"\b(?:verify|validate|check|confirm)\s+(?:whether|if|that)?\s+[a-z0-9\s-]+?\b(?:was|is|reached|achieved|produced|drilled|stands\s+at)\s+\d+",
        r"\bis\s+it\s+true\s+that\b",
        r"\bcheck\s+claim\b",
    ],
    "CONFLICT_QUERY": [
        r"\b(?:conflict|conflicts|discrepancy|discrepancies|contradiction|contradictions|mismatch|data\s+conflict)\b",
        r"\bunresolved\s+(?:issues|conflicts|records)\b",
    ],
    "CALCULATION": [
        r"\b(?:calculate|compute)\s+(?:the\s+)?(?:growth|percentage|achievement|ratio|difference|variance|margin)\b",
        r"\bwhat\s+percentage\s+of\s+(?:its\s+)?target\b",
        r"\btarget\s+achievement\b",
        r"\b(?:growth|increase|decrease|change)\s+from\s+[a-z0-9\s-]+\s+to\s+[a-z0-9\s-]+",
        r"\b(?:actual\s+vs\s+target|target\s+vs\s+actual)\b",
        r"\bdivide|multiply|sum\s+of|difference\s+between\b",
    ],
    "COMPARISON": [
        r"\b(?:compare|comparison|versus|vs)\s+.*?\b(?:across|between|all\s+subsidiaries|subsidiaries)\b",
        r"\bcompare\s+[a-z0-9\s-]+\s+(?:and|with|to)\s+[a-z0-9\s-]+",
        r"\b(?:rank|ranking|highest|lowest|top\s+producing|bottom)\s+(?:subsidiary|subsidiaries|producer|mine|mines)\b",
        r"\bacross\s+all\s+subsidiaries\b",
    ],
    "TREND_ANALYSIS": [
        r"\b(?:trend|trajectory|historical|over\s+time|year\s+on\s+year|yoy|yearly|time\s+series)\b",
        r"\bhow\s+has\s+.*?\s+(?:changed|grown|evolved)\b",
    ],
    "DOCUMENT_SUMMARY": [
        r"\b(?:summarize|summary\s+of|executive\s+summary|brief\s+summary)\s+(?:the\s+)?(?:report|document|file|annual\s+report|filing)\b",
        r"\bkey\s+takeaways\s+from\s+(?:the\s+)?(?:report|document)\b",
    ],
    "EXPLANATION": [
        r"\b(?:explain\s+reasons?\s+for|why\s+did|factors?\s+(?:behind|affecting|causing)|reasons?\s+for\s+shortfall)\b",
        r"\bwhy\s+was\s+there\s+a\s+(?:shortfall|surplus|delay|gap)\b",
    ],
    "DOCUMENT_QUERY": [
        r"\bwhat\s+does\s+the\s+(?:report|document|file)\s+say\s+about\b",
        r"\baccording\s+to\s+(?:the\s+)?(?:report|document)\b",
        r"\bin\s+(?:the\s+)?(?:report|document|filing)\b",
        r"\bmentioned\s+in\s+the\s+document\b",
    ],
    "SOURCE_QUERY": [
        r"\b(?:where\s+does\s+this\s+figure\s+come\s+from|source\s+of|show\s+citation|traceability\s+of|provenance\s+of)\b",
    ],
    "REPORT_QUERY": [
        r"\b(?:generate\s+report|create\s+report|report\s+studio|export\s+report)\b",
    ],
}
INTENT_CONFIDENCE = {
    "GREETING": 0.99, "HELP": 0.95, "CAPABILITY_QUERY": 0.95, "PARLIAMENTARY_QUERY": 0.92,
    "FACT_VERIFICATION": 0.95, "CONFLICT_QUERY": 0.90, "CALCULATION": 0.92, "COMPARISON": 0.92,
    "TREND_ANALYSIS": 0.88, "DOCUMENT_SUMMARY": 0.88, "EXPLANATION": 0.85,
    "DOCUMENT_QUERY": 0.85, "SOURCE_QUERY": 0.85, "REPORT_QUERY": 0.85,
}
CLAIM_VERB_PATTERN = r"\b(?:produced|achieved|dispatched|drilled|stands at|was|reached)\b"
CLAIM_NUMBER_PATTERN = r"\b\d+(?:\.\d+)?\s*(?:mt|bcm|mm3|m|%|cr)\b"
LOOKUP_WORDS = [
    "production", "target", "offtake", "dispatch", "drilling", "overburden", "obr", "reserve",
    "stock", "capex", "borehole"]

# --- end of fixed values --------------------------------------------------------------------------


def metric_alias_rows(aliases: dict[str, list[str]] = METRIC_ALIASES) -> list[tuple[str, str, int]]:
    """(alias, code, position) in listing order."""
    flat = [(alias, code) for code, names in aliases.items() for alias in names]
    return [(alias, code, i) for i, (alias, code) in enumerate(flat)]


def metrics_frame(spark: SparkSession) -> DataFrame:
    """Metric dimension: names and units joined with the aggregation semantics."""
    names = {code: (name, unit) for code, name, unit in METRICS}
    rows = []
    for code in dict.fromkeys([*names, *METRIC_SEMANTICS]):
        name, unit = names.get(code, (code, ""))
        sem = METRIC_SEMANTICS.get(code)
        canon, allowed, entity, time, summable, default = sem or (
            DEFAULT_UNIT, [], True, True, True, "SUM")
        rows.append((code, name, unit, canon, allowed, entity, time, summable, default,
                     sem is not None))
    return spark.createDataFrame(
        rows,
        "metric_code string, metric_name string, default_unit string, canonical_unit string, "
        "allowed_units array<string>, additive_entity boolean, additive_time boolean, "
        "supports_sum boolean, default_op string, registered boolean")


def topics_frame(spark: SparkSession, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    rows = [(t, w, i) for t, words in topics.items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "topic string, keyword string, position int")


# --- fixed values: month names in calendar order, and the forms in which periods are written ---
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_NAMES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    "|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
PERIOD_FORMS = [
    ("QUARTER", r"(?i)\b(q[1-4])\s+(?:fy\s*)?(\d{4})(?:-(\d{2,4}))?\b"),
    ("RANGE", r"(?i)^fy\s+(\d{4})-(\d{2})\b"),
    ("RANGE", r"(?i)\bfy\s*(\d{4})-(\d{4})\b"),
    ("RANGE", r"(?i)\bfy\s*(\d{4})-(\d{2})\b"),
    ("RANGE", r"\b(\d{4})-(\d{2})\b"),
    ("RANGE", r"\b(\d{4})/(\d{2})\b"),
    ("END", r"(?i)\bfy(\d{4})\b"),
    ("RANGE", r"(?i)\bfinancial\s+year\s+(\d{4})-(\d{2,4})\b"),
    ("MONTH", rf"(?i)\b({MONTH_NAMES})\s+(\d{{4}})\b"),
]
# --- end of fixed values ---
