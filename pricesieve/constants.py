"""Fixed values that must equal the original application's for equal results.

Everything in this module is data: sentinels, word lists and patterns, kept in the
order in which the application states them.  Operators take them as defaults and
accept other lists as parameters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: sentinels of the product record
# ---------------------------------------------------------------------------
PRICE_NOT_FOUND = "Price not found"
UNKNOWN = "Unknown"
UNCATEGORIZED = "Uncategorized"
UNCATEGORIZED_LOW = "Uncategorized (Low Confidence)"
UNKNOWN_PRODUCT = "Unknown Product"
NO_REASONING = "No reasoning provided"

# ---------------------------------------------------------------------------
# FIXED VALUES: currency price patterns of the PDF text extractor (9, in order)
# ---------------------------------------------------------------------------
PRICE_PATTERNS = [
    r"(\$\d+(?:\.\d{2})?)",
    r"(\€\d+(?:\.\d{2})?)",
    r"(\£\d+(?:\.\d{2})?)",
    r"(\d+\s?(?:USD|EUR|CHF|CAD|AUD))",
    r"(\d+[.,]\d{2}\s?(?:USD|EUR|CHF|CAD|AUD|€|\$|\£))",
    r"(\d+[.,]\d{2}[-€])",
    r"((?:USD|EUR|CHF|CAD|AUD|€|\$|\£)\s?\d+[.,]\d{2})",
    r"(CHF\s?\d+(?:[.,]\d{2})?)",
    r"(\d+[.,]\d{2}(?:\s?[Ff]r\.?))",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: menu classifier (section words 33, price kinds 4, item formats 3)
# ---------------------------------------------------------------------------
MENU_SECTION_WORDS = [
    "appetizer", "starter", "entrée", "main course", "dessert", "beverage",
    "drink", "cocktail", "wine", "beer", "spirit", "breakfast", "lunch",
    "dinner", "brunch", "special", "menu du jour", "prix fixe", "à la carte",
    "salad", "soup", "sandwich", "pasta", "pizza", "seafood", "meat", "vegetarian",
    "vegan", "gluten-free", "children", "kids", "sides", "extras",
]
MENU_PRICE_KINDS = [r"\$\d+", r"\€\d+", r"\£\d+", r"\d+\s?(?:USD|EUR|CHF)"]
MENU_ITEM_FORMATS = [
    r"[\w\s]+\.\.\.\.\s*\$\d+",
    r"[\w\s]+\s+\$\d+",
    r"[\w\s]+\s+\d+\s*\€",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: sectioned menu (header pattern, price pattern, first section)
# ---------------------------------------------------------------------------
SECTION_HEADER_PATTERN = r"\n([A-Z][A-Z\s]{2,30})\n"
SECTION_PRICE_PATTERN = r"(\$\d+(?:\.\d{2})?|\€\d+(?:\.\d{2})?|\£\d+(?:\.\d{2})?|\d+\s?(?:USD|EUR|CHF))"
GENERAL_MENU = "General Menu"

# ---------------------------------------------------------------------------
# FIXED VALUES: menu item fallback patterns of the PDF app (7, in order)
# ---------------------------------------------------------------------------
MENU_ITEM_PATTERNS = [
    r"([A-Za-z\s\'\"]+[\w\s\'\"\-\,\(\)]*)\s*\.{2,}\s*\$?(\d+[\.,]\d+)",
    r"([A-Za-z\s\'\"]+[\w\s\'\"\-\,\(\)]*)\s+\$?(\d+[\.,]\d+)(?:\s|$)",
    r"([A-Za-z\s\'\"]+[\w\s\'\"\-\,\(\)]*?)\s+[\.\-]*\s*\$?(\d+[\.,]\d+)(?:\s|$)",
    r"([A-Za-z][\w\s\'\"\-\,\(\)]+?)\s+[\$€£]?(\d+[\.,]\d{2})",
    r"([A-Za-z][A-Za-z\s&\'\"\-\,\(\)]+)[\s\.]*[\$€£]?(\d+\.(?:\d{2})?)",
    r"([A-Za-z][A-Za-z\s&\'\"\-\,\(\)]+)[\s\.]*?(\d{1,2}\.\d{2})",
    r"\d+\.\s+([A-Za-z][A-Za-z\s&\'\"\-\,\(\)]+)[\s\.]*?(\d{1,2}\.\d{2})",
]
LINE_END_PRICE = r"(\d{1,2}\.\d{2})$"
NAME_LIST_PATTERN = r"([A-Za-z]+)\s*(\d+(?:\.\d+)*)?"
ADD_TO_BASKET = "Add to basket"

# ---------------------------------------------------------------------------
# FIXED VALUES: text repair replacement pairs (17, applied in this order)
# ---------------------------------------------------------------------------
REPAIR_REPLACEMENTS = [
    ("BBeettttuuccee", "Lettuce"),
    ("CCaammoonn", "Camembert"),
    ("GGaass", "Gas"),
    ("ppaa", "pa"),
    ("cchh", "ch"),
    ("hhoo", "ho"),
    ("ddee", "de"),
    ("BBee", "Be"),
    ("tttt", "tt"),
    ("eeee", "ee"),
    ("rraa", "ra"),
    ("vvee", "ve"),
    ("eett", "et"),
    ("oomm", "om"),
    ("aatt", "at"),
    ("eess", "es"),
    ("Sardo, Fraises", "Sardo Fraises"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: stop words of the fallback language guess (French 14, German 13)
# ---------------------------------------------------------------------------
FRENCH_WORDS = ["le", "la", "du", "de", "un", "une", "et", "est", "au", "aux", "avec", "ce", "ces", "cette"]
GERMAN_WORDS = ["der", "die", "das", "ein", "eine", "und", "ist", "von", "mit", "zu", "für", "in", "auf"]

# ---------------------------------------------------------------------------
# FIXED VALUES: price availability filters (no-price patterns 5, quote terms 10)
# ---------------------------------------------------------------------------
NO_PRICE_PATTERNS = ["price not found", "not found", "not specified", "n/a", "unknown"]
QUOTE_TERMS = [
    "contact", "quote", "custom", "call", "inquiry", "request",
    "enterprise", "estimate", "consultation", "quotation",
]
HIDDEN_FIELD_VALUES = ["none", "nan", ""]

# ---------------------------------------------------------------------------
# FIXED VALUES: confidence bands, tag labels, histogram of confidences
# ---------------------------------------------------------------------------
HIGH_CONFIDENCE = 0.7
MEDIUM_CONFIDENCE = 0.4
TAG_LABELS = ["Product & Price", "Product Only", "Price Only", "Neither"]
CONFIDENCE_BINS = 10
CONFIDENCE_RANGE = (0.0, 100.0)

# ---------------------------------------------------------------------------
# FIXED VALUES: manual edits
# ---------------------------------------------------------------------------
MANUAL_CONFIDENCE = 0.9
NO_DESCRIPTION = "No description available"

# ---------------------------------------------------------------------------
# FIXED VALUES (ours): HTML handling.  Blocks dropped, and block tags that start a
# new line in the block-text form.
# ---------------------------------------------------------------------------
HTML_DROP_BLOCKS = ["script", "style", "template"]
HTML_BLOCK_TAGS = [
    "p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table",
    "article", "section", "header", "footer", "nav", "title", "blockquote", "pre", "hr",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: chunking defaults (function default 4000/200, interface default 500)
# ---------------------------------------------------------------------------
CHUNK_SIZE = 4000
CHUNK_OVERLAP = 200
UI_CHUNK_SIZE = 500
CONTEXT_WINDOW = 50

# ---------------------------------------------------------------------------
# FIXED VALUES: document metadata keys with their source keys
# ---------------------------------------------------------------------------
DOC_METADATA_KEYS = [
    ("title", "title"), ("author", "author"), ("subject", "subject"), ("keywords", "keywords"),
    ("creator", "creator"), ("producer", "producer"), ("creation_date", "creationDate"),
    ("modification_date", "modDate"),
]
PDF_METADATA_KEYS = [("title", "/Title"), ("author", "/Author"), ("creator", "/Creator"), ("producer", "/Producer")]

# ---------------------------------------------------------------------------
# FIXED VALUES: link handling (schemes skipped when collecting PDF links)
# ---------------------------------------------------------------------------
PDF_SUFFIX = ".pdf"
PDF_CONTENT_TYPE = "application/pdf"
MENU_WORD = "menu"
MAX_RETRIES = 3
THIN_CONTENT_CHARS = 500

# ---------------------------------------------------------------------------
# FIXED VALUES: stored model answers (tag defaults, product defaults in order)
# ---------------------------------------------------------------------------
TAG_PARSE_FAILED = "Failed to parse semantic analysis after multiple attempts"
PRODUCT_DEFAULTS = [
    ("product_name", UNKNOWN_PRODUCT),
    ("price", PRICE_NOT_FOUND),
    ("category", UNCATEGORIZED),
    ("description", ""),
    ("is_plan", "false"),
    ("plan_features", ""),
    ("trial_info", ""),
    ("provider", ""),
]
FREE_PRICE = "$0"
FREE_ORIGINAL = "Free"
RELABEL_BELOW = 0.3
SUGGEST_BELOW = 0.5

# ---------------------------------------------------------------------------
# FIXED VALUES: category validation (site sections 17, context indicators 11,
# domains 7 with their keywords, heading marks 8, suggestion patterns 4)
# ---------------------------------------------------------------------------
SITE_SECTIONS = [
    "home", "about", "contact", "about us", "faq", "services",
    "products", "gallery", "portfolio", "shop", "blog", "news",
    "main menu", "main", "footer", "header", "navigation",
]
SITE_SECTION_SUGGESTION = "Consider more specific product/service categories"
CONTEXT_INDICATORS = [
    "category", "service", "product", "offering", "package",
    "plan", "option", "tier", "menu", "type", "section",
]
DOMAIN_KEYWORDS = [
    ("photography", ["photo", "session", "shoot", "portrait", "wedding", "photography"]),
    ("pet_services", ["dog", "cat", "pet", "groom", "walk", "sitting", "boarding"]),
    ("food", ["menu", "dish", "appetizer", "entree", "dessert", "drink", "beverage"]),
    ("legal", ["attorney", "lawyer", "legal", "consultation", "case", "advice"]),
    ("automotive", ["fuel", "gas", "diesel", "premium", "regular", "repair", "maintenance"]),
    ("beauty", ["salon", "spa", "hair", "nail", "facial", "massage", "treatment"]),
    ("subscription", ["plan", "tier", "monthly", "annual", "subscription", "membership"]),
]
HEADING_MARKS = ["h1>", "h2>", "h3>", "h4>", "<strong>", "**", "section", "header"]
SUGGESTION_PATTERNS = [
    r"(?:our|available) ([a-z\s]{3,30}) services",
    r"([a-z\s]{3,30}) packages?",
    r"([a-z\s]{3,30}) options",
    r"types of ([a-z\s]{3,30})",
]
MAX_SUGGESTIONS = 3

# ---------------------------------------------------------------------------
# FIXED VALUES: deduplication (weights in summation order, name boosts, patterns)
# ---------------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.8
W_NAME, W_PRICE, W_PROVIDER, W_DURATION = 0.5, 0.2, 0.2, 0.1
PROVIDER_BOOST, PROVIDER_BOOST_ABOVE = 0.15, 0.7
DURATION_BOOST, DURATION_BOOST_ABOVE = 0.1, 0.6
DURATION_PATTERN = r"(\d+)\s*(minute|min|hour|hr)s?"
MALFORMED_PATTERN = r"[A-Za-z]+\s*-\s*[A-Za-z]+\s+Free.*\d+\s*minutes?\s*Powered"
QUALITY_PRICE, QUALITY_PROVIDER, QUALITY_DESCRIPTION, QUALITY_DURATION = 3, 2, 1, 1

# ---------------------------------------------------------------------------
# FIXED VALUES: completeness check (finding kinds, messages, score step)
# ---------------------------------------------------------------------------
SHORT_NAME_MIN = 3
LOW_CONFIDENCE_BELOW = 0.4
COMPLETENESS_STEP = 0.05
COMPLETENESS_WARN_BELOW = 0.9
FINDING_MESSAGES = [
    ("missing_product_indicators", "Found {n} products with missing or very short names."),
    ("missing_price_indicators", "Found {n} products with missing prices."),
    ("missing_category_indicators", "Found {n} products with low category confidence."),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: fuel retailer detection and pairing
# ---------------------------------------------------------------------------
FUEL_URL_WORDS = [
    "loves", "shell", "bp", "exxon", "mobil", "chevron", "texaco", "marathon",
    "conoco", "phillips", "citgo", "valero", "sunoco", "speedway", "flying-j",
    "pilot", "circle-k", "76", "gas", "fuel", "petrol", "diesel",
]
FUEL_TEXT_WORDS = [
    "unleaded", "diesel", "premium", "regular", "midgrade", "e85", "ethanol",
    "propane", "def", "per gallon", "price per gallon", "fuel price", "gas price",
]
FUEL_TYPES_SHORT = ["UNLEADED", "AUTO DIESEL", "MIDGRADE", "PREMIUM", "DIESEL", "DEF", "PROPANE"]
FUEL_TYPES = [
    "UNLEADED", "REGULAR", "REGULAR UNLEADED",
    "MIDGRADE", "PLUS", "MIDGRADE UNLEADED",
    "PREMIUM", "SUPER", "PREMIUM UNLEADED",
    "DIESEL", "AUTO DIESEL", "DIESEL #2",
    "E85", "ETHANOL", "FLEX FUEL",
    "DEF", "DIESEL EXHAUST FLUID",
    "PROPANE", "CNG", "NATURAL GAS",
]
FUEL_PRICE_RE = r"\$(\d+\.\d+)"
FUEL_NEAR_LINES = 5
FUEL_REGEXES = [
    r"(\$\d+\.\d+)\s*(per|\/)\s*(gal|gallon)\s*(for|of)?\s*([A-Za-z0-9\s]+)",
    r"([A-Za-z0-9\s]+(?:gas|fuel|unleaded|diesel|premium|regular|midgrade))\s*(?:is|costs|:)?\s*(\$\d+\.\d+)",
    r"(\$\d+\.\d+)\s*(?:per|\/|for)?\s*([A-Za-z0-9\s]+(?:gas|fuel|unleaded|diesel|premium|regular|midgrade))",
]
FUEL_CATEGORY_PATTERNS = [
    r"(Regular|Unleaded|Premium|Diesel|Midgrade|Auto Diesel|DEF|Propane|E\d+|Ethanol|Gas)\s+\$?\d+\.?\d*",
    r"\$\d+\.?\d*\s+(per|\/)\s+(gal|gallon)",
    r"(fuel|gas|diesel|gasoline|petrol)\s+price",
    r"\$\d+\.?\d*\s*\n\s*(Regular|Unleaded|Premium|Diesel|Midgrade|Auto Diesel|DEF|Propane|E\d+|Ethanol|Gas)",
    r"\$\d+\.?\d*\s*\n\s*(UNLEADED|PREMIUM|DIESEL|MIDGRADE|AUTO DIESEL|DEF|PROPANE)",
]
FUEL_FALLBACK_NAMES = [
    ("diesel", "Diesel Fuel"), ("premium", "Premium Gasoline"),
    ("regular", "Regular Gasoline"), ("unleaded", "Regular Gasoline"),
]
FUEL_DEFAULT_NAME = "Fuel"
FUEL_CATEGORY = "Fuel"
FUEL_DESCRIPTION_PREFIX = "Fuel price at "
LOVES_LOCATIONS = "loves.com/locations"

# ---------------------------------------------------------------------------
# FIXED VALUES: presentation style rules, in order (style, any-of words)
# ---------------------------------------------------------------------------
STYLE_RULES = [
    ("table", ["<table", "</tr>", "</td>"]),
    ("bullet_list", ["<li>", "•", "*"]),
    ("grid", None),
    ("menu", None),
    ("packages", ["package", "plan", "tier", "subscription", "pricing"]),
    ("fuel_prices", ["fuel", "gas", "diesel"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: booking pages (URL words, card classes, field selectors, patterns)
# ---------------------------------------------------------------------------
BOOKING_URL_WORDS = ["book", "appointment", "schedule"]
LEGAL_URL_WORDS = ["law", "legal"]
LEGAL_CATEGORY = "Legal Services"
PROFESSIONAL_CATEGORY = "Professional Services"
CONSULTATION = "Consultation"
FREE_WORD = "Free"
CARD_CLASSES = ["card", "service", "offering", "block"]
CARD_CLASSES_FALLBACK = ["item"]
PROVIDER_TAGS, PROVIDER_CLASSES = ["h1", "h2", "h3", "h4", "h5"], ["name", "provider", "attorney", "staff"]
PROVIDER_TAGS_2, PROVIDER_CLASSES_2 = ["strong"], ["provider-name", "staff-name"]
SERVICE_TAGS, SERVICE_CLASSES = ["h3", "h4", "h5"], ["service-name", "service-title"]
DURATION_CLASSES = ["duration", "time"]
BOOKING_PATTERNS = [
    r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s*[\n\r]*(?:<[^>]+>)*\s*([^<\n\r]+?)(?:\s*<[^>]+>)*(?:[\n\r]*|\s+)(\d+\s*minutes?)(?:\s*·\s*\$(\d+))?",
    r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s*[\n\r]*(?:<[^>]+>)*\s*(Free\s*[^<\n\r]+?)(?:\s*<[^>]+>)*(?:[\n\r]*|\s+)(\d+\s*minutes?)",
    r"([A-Z][a-z]+\s+[A-Z][a-z]+)[^<>]*?(?:<[^>]+>)*([^<>]{3,50}?)(?:<[^>]+>)*[\n\r]",
]
BOOKING_WINDOW = 100

# ---------------------------------------------------------------------------
# FIXED VALUES: items from an external extraction service
# ---------------------------------------------------------------------------
EXTERNAL_CONFIDENCE = 0.8
EXTERNAL_EXTRACTOR = "ScrapeGraphAI"

# ---------------------------------------------------------------------------
# FIXED VALUES: menu-line pass, currency fallback, labels of the PDF extractors
# ---------------------------------------------------------------------------
MENU_LINE_NAME = r"([A-Za-z\s\'\"\-]+)\s+"
CURRENCY_PATTERNS = [
    r"[€$£]?\s*(\d+[\.,]\d{2})",
    r"(\d+[\.,]\d{2})[€$£]",
    r"[€$£]?\s*(\d+)",
]
CURRENCY_SYMBOLS = ["€", "$", "£"]
CURRENCY_MIN_LINE = 5
MENU_CATEGORY = "Menu Item"
MENU_EXTRACTOR = "PDF Menu Extractor"
NAME_LIST_PRICE = "0.00"
NAME_LIST_MIN_ITEMS = 3

# ---------------------------------------------------------------------------
# FIXED VALUES: indicators of products possibly missed (pattern, kind), in order
# ---------------------------------------------------------------------------
PRODUCT_INDICATORS = [
    (r"\b(service|product)s?\s+(include|include[ds]|offer[eds]|available|options?)\b", "Service offerings"),
    (r"\b(price[ds]?|cost[s]?|rate[s]?)\s+(from|start\s+at|beginning\s+at)\s+\$?\d+", "Price list"),
    (r"\b(package|bundle|deal|special|promotion)\b", "Package or promotion"),
    (r"\btier[s]?\b|\bplan[s]?\b|\bsubscription[s]?\b", "Subscription plan"),
    (r"\bfree\s+(consultation|estimate|quote|assessment|trial|discovery)\b", "Free service"),
    (r"\bchoose\s+(from|between)\b", "Product selection"),
    (r"\boption[s]?\b\s+(include|available|to choose)", "Service options"),
    (r"\b(hour[s]?|minute[s]?)\s+[a-zA-Z]+\s+\$\d+", "Hourly service"),
]
INDICATOR_WINDOW = 100
NAME_GRAM = 3
TEXT_FINDING_MESSAGES = [
    ("missing_product_indicators", "Found {n} potential product indicators that may not be captured in the data."),
    *FINDING_MESSAGES[1:],
]
