"""Marker patterns, thresholds and word lists that decide annotations.

They are data, stated in the Unicode-aware dialect of ``pyregex`` and matched without regard
to case unless a comment says otherwise. Order matters where the text says so.
"""

# Measurement bases, first pattern of a class that hits gives the evidence. A bare
# "installiert" is deliberately no marker.
BASIS_PATTERNS = {
    "sales": (
        r"Verkauf\w*",
        r"verkauft\w*",
        r"Absatz\w*",
        r"\bsold\b",
        r"\bsales\b",
    ),
    "installed_annual": (
        r"Zubau\w*",
        r"hinzugebaut\w*",
        r"zugebaut\w*",
        r"neu\s+installiert\w*",
        r"neu\s+erstellt\w*",
        r"newly\s+installed",
        r"annual\s+install\w*",
        r"j(?:ä|a)hrlich\w*\s+install\w*",
        r"newly\s+added",
        r"annual\s+additions?",
        r"additional\s+\w+\s+capacity",
    ),
    "installed_cumulative": (
        r"Total\s+installiert\w*",
        r"Gesamtleistung",
        r"gesamte\s+installiert\w*",
        r"kumuliert\w*",
        r"cumulative",
        r"total\s+installed",
        r"installiert\w*\s+Leistung\s+\w{0,12}\s{0,1}Ende\s+\d{4}",
        r"Ende\s+\d{4}\s+rund",
    ),
    "production": (
        r"Stromproduktion",
        r"Energieproduktion",
        r"Produktion",
        r"produziert\w*",
        r"Erzeugung",
        r"\bproduction\b",
        r"\bgenerated\b",
        r"\bgeneration\b",
    ),
}

# Years: a four-digit number, not part of a grouped or decimal number, not carrying a unit.
YEAR = (
    r"(?<![\d'.])(1[89]\d{2}|20\d{2}|21\d{2})(?!['\d]|\.\d)"
    r"(?!\s*(?:MW|MWp|MWh|GW|GWh|kW|kWh|TW|TWh|TJ|GJ|PJ|MJ|m2|m²|km2)\b)"
)
FIRST_YEAR, LAST_YEAR = 1900, 2100

# Programme names carry a year that is no data point.
PROGRAMME_NAME = (
    r"\b(?:Energiestrategie|Energieperspektiven|Perspektiven|Strategie|"
    r"Szenarien|Szenario|Programm|Agenda)\s+\d{4}\+?"
)

# Truncation (case-sensitive).
OPENS_WITH_CLOSING_TAG = r"^\s*</\w+>"
DANGLING_VALUE = r"[:,=~]\s*$|[-–]\s*$"
CLEAN_ENDING = r"(?:>|[.!?%\"')\]]|\d)\s*$"
REASON_ORPHAN_TAG = "starts with a closing tag, so the passage begins mid-block"
REASON_UNBALANCED = "unbalanced <data> tags, so a figure transcription is cut"
REASON_DANGLING = "ends on a value separator with no value after it"
REASON_MID_TOKEN = "ends mid-token rather than at a sentence or tag boundary"

PROJECTION = (
    r"\bprognose\w*|\bvoraussichtlich\w*|\berwartet\w*|\bhochrechnung\w*|"
    r"\bprojected\b|\bprojection\b|\bforecast\w*|\bestimated at\b|"
    r"\bexpected to\b|\bwird geschätzt\b|geschätzt.{0,30}\b20\d{2}\b|"
    r"hatched|schraffiert"
)

# How a figure's numbers were obtained.
IMAGE_TYPE = r"<image_type>(.*?)</image_type>"
TABLE_HINT = r"\btable\b|\btabelle\b|\bdatentabelle\b"
LABEL_HINT = (
    r"data labels?|as labell?ed|labell?ed on the (?:chart|figure|graph)|"
    r"printed on|values are (?:shown|displayed|given) (?:on|in) the|"
    r"abgelesen aus der Legende|exact figures"
)
VISUAL_HINT = (
    r"visual interpretation|visually estimat\w+|read off|reading off|"
    r"estimated from the (?:chart|figure|graph|image)|bar heights?|"
    r"cannot be determined from the image|approximate\w* from the"
)

# Chart blocks. Row starts and prose markers are case-sensitive.
ROW_START = r"\b(?:1[89]\d{2}|20\d{2})(?:\s*\([^)]*\))?\s*,"
PROSE_MARKER = r"\b(?:Note:|Estimated Data Ranges:|Source:|Sources:)"
EXACT_NUMBER = r"-?\d+(?:\.\d+)?"
NUMBER_RANGE = r"(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)"
ESTIMATION_WORDS = (
    r"estimated|estimates|estimation|approximate|visual interpretation|"
    r"cannot be determined|read off|geschätzt|Schätzung|ungefähr"
)
EXACTNESS_CLAIM = r"exact figures|as labell?ed|data labels|printed on|abgelesen aus der Legende"

# Names of stored documents: <date>_<slug>.pdf, and the looser dated object key.
DOCUMENT_NAME = r"^(\d{4}-\d{2}-\d{2})_(.+)\.pdf$"
DATED_KEY = r"^(\d{4}-\d{2}-\d{2})[_-](.+?)\.[A-Za-z0-9]+$"

# Glossary candidates: labels that are measurements or start with a number are none.
MEASUREMENT = r"^[\d\s.,%'’‘–—+/:-]*\d[\d\s.,%'’‘–—+/:-]*$"
LEADING_NUMBER = r"^[\d\s.,'’‘+-]*\d"

# Catalogue matching.
MATCH_THRESHOLD = 0.65
DATE_BONUS = 0.5
PDF_BONUS = 0.25
TITLE_STOPWORDS = (
    "der", "die", "das", "und", "von", "fur", "des", "dem", "den", "aus", "mit", "zur", "zum", "bis", "auf", "eine",
)
DOWNLOAD_URL_PREFIX = "https://pubdb.bfe.admin.ch/de/publication/download/"

# Catalogue listing pages.
LISTING_ITEM = r'<div class="list-group-item">(.*?)</div>'
LISTING_TITLE = r"<strong>(.*?)</strong>"
LISTING_DATE = r"Erschienen:\s*(\d{2})\.(\d{2})\.(\d{4})"
LISTING_FILE_TYPE = r"Dateityp:\s*([A-Za-z]+)"
LISTING_DOWNLOAD = r'href="/[a-z]{2}/publication/download/(\d+)"'

# Retrieval.
RETRIEVAL_BREADTH = 50
MAX_TIMELINE_YEARS = 5
PROBE_RESULTS = 25
PROBE_TEMPLATES = (
    "{topic}",
    "{topic} Abbildung Grafik Entwicklung",
    "Year {topic} data values by year",
    "{topic} chart extracted data year capacity production",
    "Year {topic} MW GWh TJ 2010 2015 2020 2024",
)

# Source records: fields of the short form, and the one that is shown even when null.
SOURCE_FIELDS = (
    "title", "published_at", "download_url", "file_type", "language", "media_type", "created_at", "last_updated_at",
)
CORE_SOURCE_FIELDS = ("title", "published_at", "download_url", "media_type")
ALWAYS_SOURCE_FIELD = "download_url"

# Documents.
MIN_CHARS_BEFORE_FALLBACK = 200
NO_TEXT_WARNING = "no text extracted — likely image-only PDF"
CHUNK_CHARS = 5000

# Feedback.
FEEDBACK_FIELDS = ("user_question", "answer", "user_reaction", "source")
NOT_PROVIDED = "_not provided_"

# Drawing.
VALUE_NODE_CHARS = 80
SKIPPED_VALUES = ("sourceUri", "sizeBytes", "hasText", "textTruncated", "title", "label")
SKIPPED_EDGES = ("hasLabelForm",)
