"""Fixed values.

The word lists, patterns and account names below decide results, so they are
stated plainly and in one place.
"""

# --- fixed values: header detection -------------------------------------
HEADER_KEYWORDS = [
    "date", "booking", "transaction", "amount", "debit", "credit",
    "description", "memo", "payee", "valuta", "bedrag", "datum",
    "omschrijving", "tegenrekening", "naam", "code", "fecha", "importe",
    "concepto", "saldo", "verwendungszweck",
]
SEPARATORS = [";", ",", "\t", "|"]
DENSITY_CHARS = ".,;-/"
DENSITY_THRESHOLD = 0.5
WINDOW_LINES = 20
MIN_DATA_LENGTH = 5

# --- fixed values: column mapping ---------------------------------------
DATE_KEYWORDS = ["date", "datum", "transactiedatum", "valutadatum", "time", "fecha"]
AMOUNT_KEYWORDS = [
    "amount", "bedrag", "transactiebedrag", "debit", "credit", "eur", "value",
    "betrag", "importe", "saldo",
]
DESCRIPTION_KEYWORDS = [
    "description", "omschrijving", "mededelingen", "naam", "name", "text",
    "desc", "book", "narr", "memo", "payee", "concepto", "verwendungszweck",
]
CREDIT_KEYWORDS = ["credit", "bij"]
DEBIT_KEYWORDS = ["debit", "af"]
DIRECTION_KEYWORDS = ["cd", "c/d", "direction", "type", "af_bij"]
DECIMAL_COMMA_KEYWORDS = [
    "bedrag", "valuta", "buchung", "eur", "transactiebedrag", "betrag", "importe",
]

# --- fixed values: amounts ----------------------------------------------
MINUS_SIGNS = "\u2212\u2013\u2014"
WIDE_SPACES = "\u00A0\u202F"

# --- fixed values: missing-value spellings (as in pandas' CSV reader) ----
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: text cleaning ----------------------------------------
STOP_WORDS = [
    "POS", "VISA", "TERMINAL", "CARD", "PURCHASE", "AUTH",
    "DEBIT", "CREDIT", "PAYMENT", "TRANSACTION", "DESCRIPTION",
    "AVAILABLE", "BALANCE", "DATE", "TIME",
]
NOISE_PATTERNS = [
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",  # dates
    r"\d{16}",                         # card numbers
    r"X{4,}\d{4}",                     # masked card numbers
    r"\b[A-Z0-9]{10,}\b",              # long alphanumeric ids
    r"\b\d{6,}\b",                     # long numeric ids
    r"[^\w\s]",                        # special characters
]
BANNED_TAGS = [
    "TRTP", "TRCT", "IBAN", "BIC", "CSID", "EREF", "REMI",
    "NAME", "MARF", "NR", "BEA", "SEPA", "PAS", "VAL", "KREF",
    "OMSCHRIJVING", "MEDEDELINGEN", "KENMERK", "BETALINGSKENMERK",
    "INCASSO", "ALGEMEEN", "DOORLOPEND", "EURO", "MUNT", "CODE",
    "BETALING", "ACCEPTGIRO", "SPOED", "CREDIT", "DEBIT", "BOEKDATUM",
]

# --- fixed values: accounts and categories ------------------------------
UNKNOWN_BANK_ACCOUNT = "Assets:Bank:Unknown"
BANK_ACCOUNT = "Assets:Current:Bank"
INVESTMENT_ACCOUNT_PREFIX = "Assets:Investments:"
DEFAULT_EXPENSE_ACCOUNT = "Expenses:Uncategorized"
DEFAULT_CURRENCY = "EUR"
UNCATEGORIZED = "Uncategorized"
SKIPPED = "Skipped"

# --- fixed values: security trades --------------------------------------
BUY_WORDS = ["buy", "purchase", "koop", "aankoop", "achat", "kaufen"]
SELL_WORDS = ["sell", "sold", "verkoop", "vente", "verkaufen"]

# --- fixed values: decision thresholds ----------------------------------
RESOLVE_THRESHOLD = 0.85
PREDICT_THRESHOLD = 0.7
REVIEW_THRESHOLD = 0.8
REVIEW_BATCH = 5
DISCOVERY_BATCH = 50
VECTOR_DIM = 384

# Month names and weekdays of the five header languages (English, Dutch, German, French,
# Spanish) without accents, each month's names in the order of the year; and words that stand beside them.
MONTH_NAMES = [
    "jan january januari januar jaenner janner janvier janv enero ene",
    "feb february februari februar fevrier fevr fev febrero",
    "mar march maart mrt marz maerz mars marzo",
    "apr april avril avr abril abr",
    "may mei mai mayo",
    "jun june juni juin junio",
    "jul july juli juillet juil julio",
    "aug august augustus aout agosto ago",
    "sep sept september septembre septiembre",
    "oct october oktober okt octobre octubre",
    "nov november novembre noviembre",
    "dec december dezember dez decembre diciembre dic",
]
WEEKDAY_NAMES = [
    "mon monday maandag ma montag mo lundi lun lunes",
    "tue tues tuesday dinsdag di dienstag mardi mar martes",
    "wed wednesday woensdag wo mittwoch mi mercredi mer miercoles mie",
    "thu thur thurs thursday donderdag do donnerstag jeudi jeu jueves jue",
    "fri friday vrijdag vr freitag fr vendredi ven viernes vie",
    "sat saturday zaterdag za samstag sonnabend sa samedi sam sabado sab",
    "sun sunday zondag zo sonntag so dimanche dim domingo dom",
]
DATE_FILLERS = "st nd rd th of the de del den der le el er am"
