"""Values that decide results, stated once and in plain text.

Everything in this module is fixed by the job-title domain this engine serves: change one and results
change. Longer lists (stopwords, synonyms, gender and conjugation tables) are not here: callers pass
them as files or tables (see ``titleloom.sources.gazetteers``).
"""

# --- fixed values: characters -------------------------------------------------------------------
# Replaced by one space.
SPACE_CHARACTERS = (":", ",", ";", ".", "-", "\u2013", "\t")
SPACE_SEQUENCES = ("\\t",)                     # the two characters backslash and t
# Replaced by one space before anything else is looked at.
LINE_BREAK_CHARACTERS = ("\r", "\n")
LINE_BREAK_SEQUENCES = ("\\r", "\\n")          # backslash + r, backslash + n
# Deleted.
SPECIAL_CHARACTERS = "\\()[]{}&#*+<>'\"/?!|^~@$%=`\u00b4\u00a8_"

# --- fixed values: words ------------------------------------------------------------------------
STOPWORDS_KEPT = ("sem",)
STOPWORDS_ADDED = ("in", "of", "on")
SENIORITIES = ("trainee", "junior", "pleno", "senior", "plena", "jr", "pl", "sr")
HIERARCHIES = ("lider", "chefe", "gerente", "supervisor", "coordenador", "supervisora", "coordenadora")
# Words that no plural rule touches.
PLURAL_EXCEPTIONS = (
    "empregada", "ingles", "frances", "leis", "americanas", "fisica", "fisicas", "educacaofisica",
    "educadorafisica", "instrutorafisica", "fabrica", "fabricas", "bebida", "bebidas", "vida", "vidas",
)
PLURAL_MARK = "--"
# Single words too general to stand for a role inside a longer title.
SINGLE_WORD_BLOCKLIST = (
    "arquiteto", "arquiteta", "architect", "arquitetura", "architecture",
    "medico", "medica", "fisico", "fisica", "seguranca", "security", "designer", "design",
)
STARTING_ROLE_WORDS = ("estagiario", "trainee")
# A title is cut into single roles at any of these.
TITLE_SEPARATORS = ("/", ",", " ou ", ";", "|")

# --- fixed values: limits that are part of the feature ------------------------------------------
MIN_WORD_LENGTH = 2            # shorter words do not enter the vocabulary
MAX_EDIT_DISTANCE = 2
NGRAM_MAX_TITLE_WORDS = 50     # only the first 50 words of a title are matched
NGRAM_MIN_WORDS = 1
NGRAM_MAX_WORDS = 10
SIMILAR_TITLES = 5
MIN_SIMILARITY = 0.9
SIMILARITY_TOLERANCE = 0.01
LAST_APPLIES = 200
WEEK_WINDOWS = 24
FIRST_MONTH_WINDOW = 6
LAST_MONTH_WINDOW = 12
MESSAGE_BATCH = 100
RECENT_MONTHS = 6

# --- fixed values: match types and comparison classes -------------------------------------------
MATCH_EXACT = "database"
MATCH_NGRAM = "ahocorasick"
MATCH_EMBEDDING = "word2vec"
ACTIVE_STATUS = "A"
OWN_ORGANISATION = 1
LOG_TIME_ZONE = "America/Sao_Paulo"
LOG_STATUSES = ("200", "204")
LOG_METHOD = "POST"
