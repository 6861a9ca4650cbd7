"""Constants that results depend on and that must not be changed.

Patterns are Java regular expressions. ``(?i)`` folds case; ``(?iU)`` also makes
word boundaries and classes Unicode-aware.
"""

# --- fixed values: whitespace and lookalike characters -----------------------
BLANKS = "[\\s\\p{Z}\\x1c-\\x1f\\x85]+"
HARD_BLANKS = "\u00ad|\u00a0|_x000D_"
DASH_VARIANTS = "–—‑─‐"
QUOTE_VARIANTS = "’‘"
ZERO_WIDTH_SPACE = "\u200b"
ELLIPSIS = "…"
KEY_SEPARATOR = "\x1f"

# --- fixed values: years and editions -----------------------------------------
YEAR_SPAN = "(20\\d{2})\\D+(\\d{2})"
BUDGET_YEAR = "(\\d{4}-\\d{2})"
BUDGET_YEAR_ANY_DASH = "(\\d{4}[-–]\\d{2})"
ESTIMATE_TYPES = ("estimated_actual", "budget", "forward_estimate")
HEADER_CELL_MAX = 60
OUTCOME_NAME_MAX = 80
HEADER_WINDOW = 5

# --- fixed values: file, agency and portfolio names ----------------------------
WORKBOOK_EXTENSIONS = ("xlsx", "XLSX", "xls", "xlsm", "xlsb")
AGENCY_NOISE = (
    "(?iU)\\d{4}[-–]\\d{2}|\\b(?:pb|pbs)\\b|portfolio\\s+budget\\s+statements?|pb\\s+statement"
    "|excel\\s+tables?|\\btables?\\b|\\bcleaned?\\b|\\bstatement\\b|\\bpaes\\b"
)
FOLDER_YEAR_PREFIX = "(?i)^\\d{4}[-–]\\d{2}\\s+pbs\\s+"
PORTFOLIO_YEAR_PREFIX = "(?i)^\\d{4}-\\d{2}\\s+(?:PAES|PBS|MYEFO)\\s+"
TITLE_OF_RESOURCE_TABLE = "(?i)^table\\s+1\\.1:?\\s*(.+?)\\s+resource\\s+statement"

# --- fixed values: spellings of one portfolio, canonical name -> variants ------
#: Spelling -> display name.
PORTFOLIO_NAMES = {
    "AG": "Attorney-General's",
    "AGs": "Attorney-General's",
    "ATTORNEY-GENERAL'S": "Attorney-General's",
    "ATTORNEY-GENERAL’S": "Attorney-General's",
    "Attorney General": "Attorney-General's",
    "Attorney General's": "Attorney-General's",
    "Attorney-Generals": "Attorney-General's",
    "Attorney-General’s": "Attorney-General's",
    "Attorney‑General’s": "Attorney-General's",
    "AGRICULTURE": "Agriculture",
    "AGRICULTURE AND WATER RESOURCES": "Agriculture and Water Resources",
    "Agriculture Water and the Environment": "Agriculture, Water and the Environment",
    "AWE": "Agriculture, Water and the Environment",
    "DAFF": "Agriculture, Fisheries and Forestry",
    "CCEEW": "Climate Change, Energy, the Environment and Water",
    "DCCEEW": "Climate Change, Energy, the Environment and Water",
    "ENVIRONMENT": "Environment",
    "ENVIRONMENT AND ENERGY": "Environment and Energy",
    "COMMUNICATIONS": "Communications",
    "COMMUNICATIONS AND THE ARTS": "Communications and the Arts",
    "CROSS PORTFOLIO": "Cross Portfolio",
    "DEFENCE": "Defence",
    "DVA": "Veterans' Affairs",
    "VETERANS' AFFAIRS": "Veterans' Affairs",
    "VETERANS’ AFFAIRS": "Veterans' Affairs",
    "Veteran's Affairs": "Veterans' Affairs",
    "Veterans": "Veterans' Affairs",
    "Veterans Affairs": "Veterans' Affairs",
    "Veterans’ Affairs": "Veterans' Affairs",
    "DESE": "Education, Skills and Employment",
    "Education Skills and Employment": "Education, Skills and Employment",
    "EDUCATION": "Education",
    "EDUCATION AND TRAINING": "Education and Training",
    "EMPLOYMENT": "Employment",
    "DEWR": "Employment and Workplace Relations",
    "FINANCE": "Finance",
    "TREASURY": "Treasury",
    "DFAT": "Foreign Affairs and Trade",
    "FOREIGN AFFAIRS AND TRADE": "Foreign Affairs and Trade",
    "Foreign Affairs & Trade": "Foreign Affairs and Trade",
    "Foreign Affiars and Trade": "Foreign Affairs and Trade",
    "Foriegn Affairs & Trade": "Foreign Affairs and Trade",
    "HEALTH": "Health",
    "HOME AFFAIRS": "Home Affairs",
    "IMMIGRATION AND BORDER PROTECTION": "Immigration and Border Protection",
    "HUMAN SERVICES": "Human Services",
    "Human Services (part of the Social Services Portfolio)": "Human Services",
    "INDUSTRY": "Industry",
    "DISER": "Industry, Science, Energy and Resources",
    "INDUSTRY, INNOVATION AND SCIENCE": "Industry, Innovation and Science",
    "INFRASTRUCTURE AND REGIONAL DEVELOPMENT": "Infrastructure and Regional Development",
    "Infrastructure adn Regional Development": "Infrastructure and Regional Development",
    "INFRASTRUCTURE, REGIONAL DEVELOPMENT AND CITIES": "Infrastructure, Regional Development and Cities",
    "JOBS AND INNOVATION": "Jobs and Innovation",
    "Jobs and Innovation Portfolio (Department of Industry, Innovation and Science)": "Jobs and Innovation",
    "JOBS AND SMALL BUSINESS": "Jobs and Small Business",
    "Jobs and Innovation Portfolio (Department of Jobs and Small Business)": "Jobs and Small Business",
    "PM&C": "Prime Minister and Cabinet",
    "Prime Minister & Cabinet": "Prime Minister and Cabinet",
    "PRIME MINISTER AND CABINET": "Prime Minister and Cabinet",
    "PARL": "Parliament",
    "PARLIAMENT": "Parliament",
    "Parliamentary Departments - Department of Parliamentary Services": "Parliamentary Departments",
    "SOCIAL SERVICES": "Social Services",
    "Social Services (Human Services)": "Social Services",
}

# --- fixed values: portfolio families, first family with a contained keyword wins
PORTFOLIO_FAMILIES = [
    ("Health", ["health"]),
    ("Education", ["education"]),
    ("Social Services", ["social services"]),
    ("Defence", ["defence"]),
    ("Veterans' Affairs", ["veteran"]),
    ("Treasury", ["treasury"]),
    ("Industry / Science / Resources", ["industry"]),
    ("Infrastructure / Transport", ["infrastructure"]),
    ("Agriculture", ["agricultur"]),
    ("Foreign Affairs & Trade", ["foreign affairs"]),
    ("Attorney-General's", ["attorney"]),
    ("Home Affairs / Immigration", ["home affairs", "immigration", "border protection"]),
    ("Prime Minister & Cabinet", ["prime minister", "pm&c", "pmc"]),
    ("Employment / Workplace Relations", ["employment"]),
    ("Climate Change / Energy / Environment / Water",
     ["climate change", "environment", "energy and water", "dccceew", "dcceew"]),
    ("Communications & the Arts", ["communications"]),
    ("Finance", ["finance"]),
    ("Parliamentary Departments", ["parliament"]),
]

# --- fixed values: words for the direction of a measure -------------------------
DIRECTION_WORDS = {
    "receipt": "receipt", "receipts": "receipt", "revenue": "receipt",
    "payment": "payment", "payments": "payment", "expense": "payment", "expenses": "payment",
    "capital": "capital",
}

# --- fixed values: program tables ------------------------------------------------
PROGRAM_NUMBER = "(\\d+(?:\\.\\w+)?)"
OUTCOME_TITLE = "(?i)budgeted expenses(?:\\s+and\\s+resources)?\\s+for\\s+outcome\\s*(\\d+)"
OUTCOME_LINE = "(?i)^outcome\\s*(\\d+)\\s*[:\\-]\\s*(.+)"
OUTCOME_IN_SHEET_NAME = "2\\.(\\d+)\\.1"
PROGRAM_HEADING = "(?i)^program(?:\\s+expenses)?\\s*" + PROGRAM_NUMBER + "\\s*[:\\-–—\\s]\\s*(.+)$"
PROGRAM_TOTAL = "(?i)^total\\s+(?:expenses\\s+)?(?:for\\s+)?program\\s+" + PROGRAM_NUMBER + "\\b"
PROGRAM_TOTAL_UNNUMBERED = "(?i)^total\\s+program\\s+expenses\\b"
OUTCOME_TOTAL = "(?i)^total\\s+expenses\\s+for\\s+outcome\\s+(\\d+)\\b"
OUTCOME_SUMMARY = "(?i)^outcome\\s*\\d*\\s*totals?\\s+by\\b"
NAME_FOOTNOTES = "(\\s*\\([a-z]\\))+\\s*$"

# --- fixed values: measure tables ---------------------------------------------------
MEASURE_FOOTNOTES_TABLE = "(\\s*,?\\s*\\([a-z]{1,3}\\))+$"
MEASURE_FOOTNOTES_PROSE = "(\\s*\\([a-z]{1,3}\\))+$"
FOOTNOTE_MARKER = "(?i)^\\([a-z]{1,3}\\)$"
PLACEHOLDER_NAME = "(?i)^<(?:enter|insert) measure name here>"
PROGRAM_LIST = "(?i)^(all|\\d+(?:\\.\\d+)?(?:\\s*[,&;]\\s*\\d+(?:\\.\\d+)?)*)$"
LEADING_DASH = "^[-–—‐‑]\\s"
TRAILING_DASH = "[-–—‐‑]\\s*$"
HEADING_BEFORE_DASH = "^(.+?:)\\s*[-–—‐‑]"
ANY_TABLE_TITLE = "(?i)^table\\s+\\d"
BARE_PROGRAM = "^\\d+(?:\\.\\d+)?$"
SHEET_TOKEN_1_2 = "(?<![\\d.])1\\.2(?![\\d.])"
SHEET_TOKEN_1_1 = "(?<![\\d.])1\\.1(?![\\d.])"
SHEET_NAME_EXCLUSIONS = (
    "(?iU)\\bold\\b|\\bprog(?:ram)?\\.?\\s*\\d|\\bprog(?:ram)?\\s*exp|2\\.1\\.\\d+|\\bfootnotes?\\b|\\blevies\\b"
)
# Row classes of a measure table in the order in which they are tried.
MEASURE_ROW_PATTERNS = [
    ("header", "(?i)^outcome\\s*/?\\s*program$|^program$|^\\$'?000$"),
    ("footnote", "^\\([a-z]{1,3}\\)\\s+\\S"),
    ("spare", "(?i)^\\(spare space"),
    ("cross_outcome", "(?i)^cross-outcome$"),
    ("title", "(?i)^table\\s+1\\.2\\b"),
    ("part", "(?i)^part\\s+\\d"),
    ("other_portfolio", "(?i)^other\\s+portfolio\\s+measures\\b"),
    ("section",
     "(?i)^(?:(receipts?|payments?|revenues?|expenses?|capital)\\s+)?measures?"
     "(\\s*\\(if applicable\\)|\\s*\\([a-z]+\\))*$"),
    ("grand_total",
     "(?i)^(?:\\([a-z](?:\\+[a-z])*\\)\\s*|sub-?\\s*)?total\\s+"
     "(?:(?:receipts?|payments?|revenues?|expenses?|capital)\\s+)?"
     "(?:\\d{4}-\\d{2}\\s+(?:budget|myefo)\\s+)?(?:other\\s+)?measures?\\b"),
    ("outcome_total", "(?i)^total\\s+(?:outcome\\s+\\d+|all\\s+outcomes|outcome\\s+all)$"),
    ("net_impact",
     "(?i)^(total\\s+)?net\\s+impact\\s+on\\s+appropriations\\s+for\\s+outcome\\s+\\d+(\\s*\\([a-z]+\\))?$"),
    ("other_variations", "(?i)^other\\s+variations$"),
    ("related_receipts", "(?i)^related\\s+receipts$"),
    ("total", "(?i)^total(\\s+(payments?|receipts?|revenues?|expenses?)(\\s+impact)?)?$"),
    ("outcome_block", "(?i)^outcome\\s+\\d+$"),
]
CATEGORY_LINE = (
    "(?i)^(administered|departmental|equity)(\\s+capital)?"
    "(\\s+(payments?|receipts?|revenues?|expenses?))?(\\s*\\([a-z]+\\))*$"
)
SHORT_CATEGORY_MARKERS = ("Adm", "Dep")
SPARSE_MIN_CATEGORIES = 5
SPARSE_RATIO = 0.2

# --- fixed values: write-up documents --------------------------------------------------
CONTENT_TOP, CONTENT_BOTTOM = 110.0, 730.0
LINE_TOLERANCE, WORD_GAP = 2.5, 1.0
PORTFOLIO_SIZE, HEADING_SIZE, SIZE_TOLERANCE, DIVIDER_SIZE = 12.96, 9.96, 0.5, 13.0
BULLET_GLYPHS, BULLET_INDENT = ("•", "–", "-", "*"), 112.0
SECTION_MARKER = "(?i)^(?:Part\\s+\\d+:\\s*)?(Receipt|Payment|Revenue|Expense|Capital)\\s+Measures$"
SUMMARY_CAPTION = "(?i)^Table\\s+(?:A\\.)?\\d+[:.]"
FOREIGN_APPENDIX = "(?i)^Appendix\\s+[A-Z]:\\s*Policy\\s+decisions\\s+published\\s+in\\b"
NEXT_APPENDIX = "(?i)^Appendix\\s+[B-Z]\\b"
NEXT_APPENDIX_TABLE = "(?i)^Table\\s+[B-Z]\\d"
FINANCIAL_HEADER = "(?i)^(Related\\s+)?(Receipts?|Payments?|Revenue|Expenses?|Capital)\\s*\\(\\$m\\)$"
FINANCIAL_TOTAL = "(?i)^Total\\s*[–—-]\\s*(Receipts?|Payments?|Revenue|Expenses?|Capital)$"
YEAR_COLUMN = "^\\d{4}-\\d{2}$"
WITHHELD_MARKERS = ("..", "nfp", "*")
SENTENCE_END = "[.:!?][\"”’)]*$"

# --- fixed values: presentation -----------------------------------------------------------
SNIPPET_CONTEXT = 60
EXCERPT_LENGTH = 180
LABEL_LENGTH = 55
TOPIC_DEFAULT, TOPIC_CAP = 30, 100
TOP_GROUPS = 8
MIN_TABLE_YEARS = 4
