"""Word lists, patterns, limits and thresholds that results depend on."""

# Words whose presence between spaces marks a language.
ENGLISH_WORDS = ["the", "and", "is", "in", "to", "of", "a", "that", "it", "with", "for", "as", "was", "on", "are"]
SPANISH_WORDS = ["el", "la", "de", "que", "y", "en", "un", "es", "se", "no", "te", "lo", "le", "da", "su"]
FRENCH_WORDS = ["le", "de", "et", "à", "un", "il", "être", "et", "en", "avoir", "que", "pour", "dans", "ce", "son"]

# The shorter lists, used where a document brings no language of its own.
ENGLISH_WORDS_SHORT = ["the", "and", "is", "in", "to", "of", "a", "that"]
SPANISH_WORDS_SHORT = ["el", "la", "de", "que", "y", "en", "un", "es"]
FRENCH_WORDS_SHORT = ["le", "de", "et", "à", "un", "il", "être", "en"]

# The lists for mail bodies, found within longer words too.
MAIL_ENGLISH_WORDS = ["the", "and", "is", "in", "to", "of", "a", "that", "it", "with"]
MAIL_SPANISH_WORDS = ["el", "la", "de", "que", "y", "en", "un", "es", "se", "no"]
MAIL_FRENCH_WORDS = ["le", "de", "et", "à", "un", "il", "être", "et", "en", "avoir"]

SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co"]
NETWORK_CITIES = ["mumbai", "delhi", "bangalore", "chennai", "pune", "hyderabad"]

# Substrings counted once each.
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like", "happy", "pleased"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "horrible", "hate", "dislike", "angry", "frustrated", "disappointed", "upset"]
URGENT_WORDS = ["urgent", "asap", "immediately", "emergency", "critical", "important", "rush", "deadline"]
HEALTH_WORDS = ["medical", "patient", "diagnosis", "treatment", "prescription", "doctor", "physician", "hospital", "clinic", "health"]

# Flesch reading ease: lowest score of each band.
READING_LEVELS = [(90, "very_easy"), (80, "easy"), (70, "fairly_easy"), (60, "standard"), (50, "fairly_difficult"), (30, "difficult")]

# Content patterns. Word edges are spelled out where engines differ on \b.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
URL = r'(?i)https?://[^\s<>"{}|\\^`\[\]]+'
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
NUMBER = r"\b\d+\b"
CURRENCY = r"\$\d+(?:\.\d{2})?"
PERCENTAGE = r"\d+%"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
CONTENT_PATTERNS = {"emails": EMAIL, "phones": PHONE, "urls": URL, "dates": DATE, "numbers": NUMBER, "currency": CURRENCY, "percentages": PERCENTAGE, "ssns": SSN, "cards": CARD}
FINANCIAL_PATTERNS = [r"(?i)\$\d+(?:,\d{3})*(?:\.\d{2})?", CARD, r"\b\d{9}\b", r"(?i)account\s+number"]

# Normalisation.
UNICODE_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u00ab\u00bb"
SINGLE_QUOTES = "\u2018\u2019\u201a\u2039\u203a"
DASHES = "\u2013\u2014\u2015\u2212"
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am")]

# Structure of lines.
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
BULLET_ITEM = r"^\s*[-*+]\s+.+$"
NUMBER_ITEM = r"^\s*\d+\.\s+.+$"
LETTER_ITEM = r"^\s*[a-zA-Z]\.\s+.+$"
PAGE_SECTION_PATTERNS = [r"^\d+\.?\s+[A-Z][^.]*$", r"^[A-Z][A-Z\s]{2,}[A-Z]$", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:?\s*$"]
HIERARCHY_PATTERNS = [r"^\d+\.\s", r"^[A-Z][A-Z\s]+$", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:?\s*$"]
LIST_PATTERNS = [r"^\s*[-•*]\s", r"^\s*\d+\.\s", r"^\s*[a-z]\)\s"]

# Clauses: indicators by type, in order of declaration (which breaks ties).
CLAUSE_INDICATORS = {
    "definition": [r"\b(?:means?|defined?\s+as|shall\s+mean|definition)\b", r"\b(?:for\s+the\s+purposes?\s+of|in\s+this\s+agreement)\b", r'^\s*"[^"]+"\s+means?'],
    "obligation": [r"\b(?:shall|must|will|agrees?\s+to|undertakes?\s+to|obligated?\s+to)\b", r"\b(?:responsible\s+for|duty\s+to|required\s+to)\b", r"\b(?:covenant|promise|guarantee)\b"],
    "right": [r"\b(?:entitled\s+to|right\s+to|may|permitted\s+to|authorized\s+to)\b", r"\b(?:privilege|license|authority)\b"],
    "condition": [r"\b(?:if|unless|provided\s+that|subject\s+to|conditional\s+upon)\b", r"\b(?:in\s+the\s+event\s+that|where|when|whenever)\b"],
    "payment": [r"\b(?:payment|pay|fee|cost|expense|charge|amount|sum)\b", r"\b(?:invoice|bill|remuneration|compensation)\b", r"\$[\d,]+|\b\d+\s*(?:dollars?|USD|EUR|GBP)\b"],
    "termination": [r"\b(?:terminat|expir|end|ceas|discontinu)\b", r"\b(?:breach|default|violation|non-compliance)\b", r"\b(?:notice\s+of\s+termination|effective\s+date)\b"],
    "liability": [r"\b(?:liable|liability|responsible|damages|loss|harm)\b", r"\b(?:indemnif|compensat|reimburse)\b"],
    "confidentiality": [r"\b(?:confidential|proprietary|non-disclosure|secret)\b", r"\b(?:disclose|reveal|share|divulge)\b"],
    "governing_law": [r"\b(?:governing\s+law|applicable\s+law|jurisdiction)\b", r"\b(?:courts?\s+of|legal\s+proceedings)\b"],
    "force_majeure": [r"\b(?:force\s+majeure|act\s+of\s+god|unforeseeable)\b", r"\b(?:natural\s+disaster|war|pandemic|government\s+action)\b"],
}
LIKELY_CLAUSE = [r"\b(?:shall|must|will|agrees?|undertakes?)\b", r"\b(?:party|parties|agreement|contract)\b", r"\b(?:liable|liability|responsible|damages)\b", r"\b(?:breach|default|violation|termination)\b", r"\b(?:confidential|proprietary|intellectual\s+property)\b", r"\b(?:payment|fee|cost|compensation)\b", r"\b(?:governing\s+law|jurisdiction|dispute)\b"]
REFERENCES = [(r"(?i)\b(?:Section|Article|Clause|Paragraph)\s+(\d+(?:\.\d+)*)\b", 1), (r"(?i)\b(?:subsection|subparagraph)\s+\(([a-z0-9]+)\)\b", 1), (r"(?i)\b(?:Schedule|Appendix|Exhibit)\s+([A-Z\d]+)\b", 1), (r"(?i)\b(?:above|below|herein|hereof|hereto|hereunder)\b", 0)]
#: Words in lower case, one of which a match of each of ``REFERENCES`` holds.
REFERENCE_WORDS = [["section", "article", "clause", "paragraph"], ["subsection", "subparagraph"], ["schedule", "appendix", "exhibit"], ["above", "below", "here"]]
KEY_TERMS = [r"\b(?:agreement|contract|party|parties)\b", r"\b(?:breach|default|violation|non-compliance)\b", r"\b(?:damages|liability|indemnification|compensation)\b", r"\b(?:confidential|proprietary|intellectual\s+property)\b", r"\b(?:termination|expiration|renewal)\b", r"\b(?:governing\s+law|jurisdiction|dispute\s+resolution)\b", r"\b(?:force\s+majeure|act\s+of\s+god)\b", r"\b(?:warranty|representation|guarantee)\b", r"\b(?:assignment|transfer|delegation)\b", r"\b(?:notice|notification|communication)\b"]
NUMBERINGS = [r"^\s*(\d+(?:\.\d+)*\.?)\s+(.+)$", r"(?i)^\s*([ivxlcdm]+\.?)\s+(.+)$", r"^\s*([a-z]\.?)\s+(.+)$", r"^\s*\(([a-z0-9]+)\)\s+(.+)$", r"^\s*\[([a-z0-9]+)\]\s+(.+)$"]
#: How a text begins that one of ``NUMBERINGS`` matches.
NUMBERING_START = r"^\s*(?:\d|[IVXLCDMivxlcdm]+\.?\s|[a-z]\.?\s|[(\[][a-z0-9])"
STRUCTURES = [("article", r"(?i)^\s*ARTICLE\s+([IVXLCDM\d]+)"), ("section", r"(?i)^\s*SECTION\s+(\d+(?:\.\d+)*)"), ("clause", r"(?i)^\s*CLAUSE\s+(\d+(?:\.\d+)*)"), ("paragraph", r"(?i)^\s*PARAGRAPH\s+(\d+(?:\.\d+)*)"), ("schedule", r"(?i)^\s*SCHEDULE\s+([A-Z\d]+)"), ("appendix", r"(?i)^\s*APPENDIX\s+([A-Z\d]+)"), ("exhibit", r"(?i)^\s*EXHIBIT\s+([A-Z\d]+)")]
#: The letters that one of ``STRUCTURES`` begins with.
STRUCTURE_START = r"^\s*[ASCPEascpe]"

# Claim questions.
AGE_PATTERNS = [r"(\d{1,2})[- ]?year[s]?[- ]?old", r"age[:\s]*(\d{1,2})", r"(\d{1,2})[- ]?yr[s]?[- ]?old", r"(\d{1,2})[- ]?years?"]
MALE = r"\b(male|man|mr\.?|gentleman)\b"
FEMALE = r"\b(female|woman|mrs?\.?|ms\.?|lady)\b"
PROCEDURES = {
    "knee surgery": ["knee", "surgery", "arthroscopy", "meniscus", "acl", "pcl"],
    "heart surgery": ["heart", "cardiac", "bypass", "angioplasty", "stent"],
    "eye surgery": ["eye", "cataract", "lasik", "retina", "glaucoma"],
    "dental": ["dental", "tooth", "root canal", "extraction", "implant"],
    "maternity": ["pregnancy", "delivery", "caesarean", "c-section", "maternity"],
    "cancer treatment": ["cancer", "chemotherapy", "radiation", "oncology", "tumor"],
    "accident": ["accident", "fracture", "injury", "emergency", "trauma"],
}
CITIES = ["mumbai", "delhi", "bangalore", "hyderabad", "ahmedabad", "chennai", "kolkata", "pune", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal", "visakhapatnam", "pimpri", "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "faridabad", "meerut"]
POLICY_AGE_PATTERNS = [r"(\d+)[- ]?month[s]?[- ]?old\s+(?:insurance\s+)?policy", r"policy\s+(?:is\s+)?(\d+)[- ]?month[s]?\s+old", r"(\d+)[- ]?month[s]?[- ]?old\s+insurance"]
POLICY_DURATION_PATTERNS = [(r"(\d+)[- ]?month[s]?\s+policy", 1), (r"policy\s+(?:of\s+)?(\d+)[- ]?month[s]?", 1), (r"(\d+)[- ]?year[s]?\s+policy", 12)]
HOSPITAL_PATTERNS = [r"(?:at\s+)?([A-Z][a-zA-Z\s]+?)\s+hospital", r"hospital[:\s]+([A-Z][a-zA-Z\s]+)", r"([A-Z][a-zA-Z\s]+?)\s+medical\s+center"]
DATE_PATTERNS = [r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(?i)(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{2,4})", r"(?i)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2},?\s+\d{2,4})"]
AMOUNT_PATTERNS = [r"(?i)(?:rs\.?|inr|₹)\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"(?i)(\d+(?:,\d{3})*(?:\.\d{2})?)\s*(?:rs\.?|inr|₹|rupees)", r"(?i)amount[:\s]*(?:rs\.?|inr|₹)?\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"]
ASSUMPTIONS = {
    "age": "no age given: taken as an adult",
    "gender": "no gender given: rules for all genders apply",
    "location": "no place given: taken as treated in India",
    "policy": "no policy age or term given: waiting periods are tested",
    "hospital": "no hospital given: taken as one of the network",
}

# Claim decisions. Amounts in rupees, periods in months.
WAITING_MONTHS = {"knee surgery": 24, "heart surgery": 36, "eye surgery": 12, "dental": 6, "maternity": 10, "cancer treatment": 48, "accident": 0, "critical illness": 3, "opd": 0}
COVERAGE_LIMITS = {"knee surgery": 200000, "heart surgery": 500000, "eye surgery": 100000, "dental": 50000, "maternity": 150000, "cancer treatment": 1000000, "accident": 300000, "critical illness": 2000000, "opd": 25000}
OPD_SUB_LIMITS = {"consultation": 1000, "diagnostics": 2000, "medicines": 5000, "dental": 2000, "physiotherapy": 3000}
CRITICAL_ILLNESSES = ["cancer", "heart attack", "stroke", "kidney failure", "major organ transplant", "multiple sclerosis", "paralysis", "coma", "coronary artery bypass", "primary pulmonary hypertension"]
AGE_BANDS = [(0, 18, 1.0), (19, 35, 1.0), (36, 50, 1.1), (51, 65, 1.3), (66, 100, 1.5)]
COVERAGE_WORDS = ["covered", "eligible", "benefits", "reimburse", "payable"]
EXCLUSION_WORDS = ["excluded", "not covered", "shall not", "except", "not eligible"]
WAITING_WORDS = ["waiting period", "after", "months", "cooling period", "moratorium"]
SUB_LIMIT_ITEMS = ["room rent", "icu", "cataract", "knee replacement"]
PERMANENT_EXCLUSIONS = ["cosmetic", "infertility", "hiv", "aids", "experimental"]
ACCIDENT_EXCLUSIONS = ["self-inflicted", "intoxication", "hazardous", "suicide"]
CLAUSE_AMOUNT_PATTERNS = [(AMOUNT_PATTERNS[0], 1), (AMOUNT_PATTERNS[1], 1), (r"(?i)(?:sum insured|coverage|limit).*?(?:rs\.?|inr|₹)?\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", 1), (r"(?i)(\d+)\s*lakh", 100000), (r"(?i)(\d+)\s*crore", 10000000)]
CLAUSE_MONTHS_PATTERNS = [(r"(?i)(\d+)\s*months?", 1), (r"(?i)(\d+)\s*years?", 12)]
CLAIM_CAP = 500000
NEWBORN_LIMIT = 50000
DAYCARE_LIMIT = 50000

#: Fields of format-specific metadata: the name given and the key in the scan's own metadata.
PDF_FIELDS = {"creation_date": "CreationDate", "modification_date": "ModDate", "author": "Author", "title": "Title", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer"}
DOCX_PROPERTIES = ["title", "author", "subject", "keywords", "category", "comments", "created", "modified", "last_modified_by", "revision", "version"]
DOCX_COUNTS = ["paragraph_count", "section_count", "tables_count", "images_count"]
MAIL_FIELDS = {"subject": "subject", "from_address": "from", "date_sent": "date", "message_id": "message_id"}
MAIL_FLAGS = {"is_multipart": "is_multipart", "has_attachments": "has_attachments", "has_html_content": "has_html"}
