"""Word lists, patterns and tables results depend on."""

# ---- fixed values: cells that mean "missing" --------------------------------
MISSING_TOKENS = [
    "", "-", "--", "n/a", "N/A", "na", "NA", "NaN", "nan", "null", "NULL",
    "none", "None", "..", "...", ":", "—", "–", "?", "غير متاح", "لا يوجد",
]

# ---- fixed values: boolean words --------------------------------------------
TRUE_WORDS = ["true", "yes", "y", "1", "نعم", "صحيح"]
FALSE_WORDS = ["false", "no", "n", "0", "لا", "خطأ"]

# ---- fixed values: currency marks -------------------------------------------
CURRENCY = "[$€£¥₹]|USD|EUR|GBP|SAR|AED|DZD"

# ---- fixed values: URL handling ---------------------------------------------
TRACKING_PREFIXES = ["utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref_src"]
BLOCKED_HOST_SUFFIXES = [".localhost", ".local", ".internal", ".home.arpa"]
BLOCKED_HOST_NAMES = ["localhost", "localhost.localdomain", "ip6-localhost"]
METADATA_HOSTS = [
    "169.254.169.254", "metadata.google.internal", "metadata.goog", "instance-data",
]
BLOCKED_PORTS = [22, 23, 25, 445, 3306, 5432, 6379, 9200, 11211]
PAGE_PARAMS = ["page", "p", "pagenum", "page_number", "pageindex", "pg", "start_page"]
OFFSET_PARAMS = ["offset", "start", "from", "skip"]
SKIPPED_LINK_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

# IPv4 ranges that are not public (first address, prefix length).
NON_PUBLIC_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
]
# Written prefixes of IPv6 addresses that are not public.
NON_PUBLIC_V6 = r"^(::1?$|::ffff:|f[cd]|fe[89abcdef]|ff|2001:0?db8:)"

# ---- fixed values: file formats ---------------------------------------------
DATA_EXTENSIONS = {
    ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".json": "json",
    ".jsonl": "jsonl", ".ndjson": "jsonl", ".xml": "xml", ".xls": "excel",
    ".xlsx": "excel", ".xlsm": "excel", ".parquet": "parquet",
    ".feather": "feather", ".zip": "zip", ".dta": "stata", ".sav": "spss",
    ".rds": "rds",
}
DOCUMENT_EXTENSIONS = {
    ".pdf": "pdf", ".doc": "word", ".docx": "word", ".ppt": "powerpoint",
    ".pptx": "powerpoint",
}
CONTENT_TYPES = {
    "text/csv": "csv", "application/csv": "csv",
    "text/tab-separated-values": "tsv", "application/json": "json",
    "application/x-ndjson": "jsonl", "application/ld+json": "json",
    "application/vnd.ms-excel": "excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel",
    "application/vnd.apache.parquet": "parquet", "application/zip": "zip",
    "application/pdf": "pdf", "application/xml": "xml", "text/xml": "xml",
    "application/rss+xml": "feed", "application/atom+xml": "feed",
}
FEED_HINT = r"(?i)(/feed/?$|/rss|\.rss$|atom\.xml|feed\.xml)"
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json"]

# ---- fixed values: page safety ----------------------------------------------
INJECTION_PATTERNS = [
    r"(?i)ignore (all|any|the) (previous|prior|above) instructions",
    r"(?i)disregard (your|the) (system|previous) (prompt|instructions)",
    r"(?i)you are (now|actually) (a|an) [a-z ]{0,30}assistant",
    r"(?i)(send|reveal|print|share) (the |your )?(api[_ ]?key|password|token|secret)",
    r"(?i)</?(system|assistant|instructions)>",
    r"(?i)\bprompt injection\b",
]
CHALLENGE_MARKERS = [
    "captcha", "recaptcha", "hcaptcha", "cf-challenge", "checking your browser",
    "verify you are human", "attention required! | cloudflare",
    "enable javascript and cookies to continue",
]
LOGIN_MARKERS = [
    "please log in", "please sign in", "login required", "sign in to continue",
    "create a free account to continue", "subscribe to read",
]
SCRIPT_FRAMEWORK_HINT = (
    r"(?i)(__NEXT_DATA__|window\.__NUXT__|ng-version|data-reactroot|react-root|vue-app|"
    r"__vite|hydrate|angular\.min\.js|require\(\[)"
)

# ---- fixed values: page structure -------------------------------------------
SKIP_TAGS = ["script", "style", "noscript", "svg", "path", "template", "br", "hr"]
NOISE_CLASS = r"(?i)(nav|menu|footer|header|breadcrumb|pagination|cookie|banner|social)"
NAMED_FIELD_TAGS = ["span", "p", "div", "li", "strong", "em", "dd", "td"]
NEXT_TEXT = r"(?i)^\s*(next|next page|older|more|›|»|→|التالي|التالية|المزيد)\s*$"
LOAD_MORE_TEXT = r"(?i)(load more|show more|view more|see more|عرض المزيد|تحميل المزيد)"
INFINITE_HINT = (
    r"(?i)(infinite[-_ ]?scroll|data-infinite|IntersectionObserver|scroll-?loader|lazy-?load-?more)"
)
STATE_NAMES = ["__NUXT__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__"]
JSON_SCRIPT_TYPES = ["application/json", "application/x-json"]
API_URL_IN_SCRIPT = (
    r"""["']((?:https?:)?//[^"'\s]+?/(?:api|v\d|rest|graphql|data|json)[^"'\s]*"""
    r"""|/(?:api|rest|v\d|data)/[^"'\s]{2,120})["']"""
)
API_PATH_HINT = (
    r"(?i)(/api/|/rest/|/v\d+/|/data/|\.json(\?|$)|format=json|output=json)"
)
DATASET_KEY_HINT = (
    r"(?i)^(data|items|results|records|rows|values|observations|series|entries|features"
    r"|content|list|docs)$"
)
CURSOR_KEY = (
    r"(?i)^(next|next_page|next_cursor|next_page_token|nextPageToken|cursor|after|continuation.*)$"
)
CURSOR_CONTAINERS = ["meta", "pagination", "paging", "page", "info"]
WRAPPER_KEYS = ["records", "data", "items", "results", "rows", "output", "extracted"]
HTML_HINT = r"(?i)<\s*(html|body|table|div|ul|ol|section|article|tr|li)\b"

# ---- fixed values: requested-field dictionary (phrase -> name, dtype) --------
FIELD_TERMS = {
    "country": ("country", "string"), "countries": ("country", "string"),
    "nation": ("country", "string"), "الدولة": ("country", "string"),
    "البلد": ("country", "string"), "year": ("year", "integer"),
    "السنة": ("year", "integer"), "date": ("date", "date"),
    "التاريخ": ("date", "date"), "month": ("month", "string"),
    "inflation": ("inflation", "number"), "inflation rate": ("inflation", "number"),
    "التضخم": ("inflation", "number"), "معدل التضخم": ("inflation", "number"),
    "gdp": ("gdp", "number"), "gross domestic product": ("gdp", "number"),
    "الناتج المحلي": ("gdp", "number"), "الناتج المحلي الإجمالي": ("gdp", "number"),
    "unemployment": ("unemployment", "number"),
    "unemployment rate": ("unemployment", "number"),
    "البطالة": ("unemployment", "number"), "معدل البطالة": ("unemployment", "number"),
    "population": ("population", "number"), "السكان": ("population", "number"),
    "price": ("price", "number"), "السعر": ("price", "number"),
    "value": ("value", "number"), "القيمة": ("value", "number"),
    "unit": ("unit", "string"), "الوحدة": ("unit", "string"),
    "source": ("source", "string"), "المصدر": ("source", "string"),
    "title": ("title", "string"), "العنوان": ("title", "string"),
    "author": ("author", "string"), "الكاتب": ("author", "string"),
    "link": ("link", "url"), "url": ("url", "url"), "الرابط": ("link", "url"),
    "name": ("name", "string"), "الاسم": ("name", "string"),
    "description": ("description", "string"), "الوصف": ("description", "string"),
    "category": ("category", "string"), "التصنيف": ("category", "string"),
    "rating": ("rating", "number"), "التقييم": ("rating", "number"),
    "currency": ("currency", "string"), "العملة": ("currency", "string"),
    "region": ("region", "string"), "المنطقة": ("region", "string"),
    "code": ("code", "string"), "الرمز": ("code", "string"),
}

# ---- fixed values: columns and limits ---------------------------------------
PROVENANCE_COLUMNS = ["_source_url", "_source_page", "_retrieved_at", "_extraction_method"]
NON_MEASURE = ["year", "id", "code", "rank", "page", "index", "no", "num", "سنة", "رقم"]
MIN_ITEMS = 4
MAX_REPEATED = 6
MAX_INTERNAL_LINKS = 2000
HARD_MAX_PAGES = 2000

# ---- fixed values: texts that appear in results -------------------------------
CHART_REASONS = {
    "line": "A date column combined with a numeric column reads best as a time series.",
    "bar": "A category with a numeric measure compares well as a bar chart.",
    "scatter": "Two numeric columns show their relationship in a scatter plot.",
    "histogram": "A single numeric column is best understood through its distribution.",
    "frequency": "Category-only data is summarised by frequency.",
    "missingness": "Some values are missing; this shows where.",
}
PROVENANCE_NOTE = "Provenance column added by the application."
NEW_FIELDS = "New fields appeared on later pages: "
ABSENT_FIELDS = "Expected fields were absent on some pages: "

# fixed values: numbers as they are written
BRACKETED_NUMBER = r"^\s*\(([\d\s.,]+)\)\s*$"
PERCENT_NUMBER = r"^\s*([-+]?[\d\s.,]+)\s*%\s*$"
CURRENCY_NUMBER = rf"(?i)^\s*(?:{CURRENCY})?\s*([-+]?[\d\s.,]+)\s*(?:{CURRENCY})?\s*$"
PLAIN_NUMBER = r"^[-+]?[\d\s.,]+$"
NUMBER_MARKS = r"[%$€£¥₹,\s]|USD|EUR|GBP"
NUMBER_LIKE = r"^[-+]?[\d.,\s%$€£]+$"

# fixed values: dates as they are written; month first when both readings are possible
DATED = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
DATE_LIKE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}/\d{2}"
DATE_START = r"^(\d{1,2}[-/. ]|\d{4}|[A-Za-z]{3,9} \d{1,2}, \d{4}$)"
DATE_SHAPES = {
    r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$": [None],
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["M/d/yyyy", "d/M/yyyy"],
    r"^\d{1,2}[.]\d{1,2}[.]\d{4}$": ["M.d.yyyy", "d.M.yyyy"],
    r"^\d{1,2}-\d{1,2}-\d{4}$": ["M-d-yyyy", "d-M-yyyy"],
    r"^\d{4}/\d{1,2}/\d{1,2}$": ["yyyy/M/d"],
    r"^\d{4}/\d{1,2}$": ["yyyy/M"],
    r"^\d{8}$": ["yyyyMMdd"],
    r"^\d{1,2} [A-Za-z]{3,9} \d{4}$": ["d MMM yyyy", "d MMMM yyyy"],
    r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$": ["MMM d, yyyy", "MMMM d, yyyy"],
    r"^\d{4}$": ["yyyy"],
}

# fixed values: characters that a column name keeps
NAME_CHARACTERS = "[0-9a-zA-Z؀-ۿ]+"

# fixed values: dataset kinds a preset prefers
PRESETS = {
    "auto": [], "table": ["table"], "listings": ["repeated"], "article": ["article"],
    "api": ["api"], "multipage": [], "document": ["document"],
    "research": ["api", "table", "file"],
}

# fixed values: names of cleaning steps in the change report
STEP_NAMES = {
    "trim": "Trim whitespace",
    "missing": "Normalize missing tokens",
    "numbers": "Numeric conversion",
    "dates": "Parse dates",
    "booleans": "Normalize booleans",
    "categories": "Normalize categories",
    "names": "Standardize column names",
    "duplicates": "Remove duplicate rows",
    "outliers": "Flag outliers",
}

# fixed values: content types of captures, and titles of candidates
PAGE_TYPES = ["text/html", "application/xhtml+xml"]
FEED_BODY_TYPES = ["application/xml", "text/xml", "application/rss+xml", "application/atom+xml"]
FEED_TITLE = "RSS/Atom feed entries"
ARTICLE_TITLE = "Article / main text"
FILES_TITLE = "Files linked from this page"
LINKS_TITLE = "Links on this page"
STRUCTURED_TITLE = "Structured metadata (schema.org)"
