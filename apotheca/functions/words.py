"""Word lists of the catalogue. They decide results and are stated as they must be."""

# Salts that begin a substance's name; the first that fits is taken.
SALT_PREFIXES = (
    "FUMARATE ACIDE DE", "HEMIFUMARATE DE", "CHLORHYDRATE DIHYDRATE DE", "DIPROPIONATE DE", "DIPROPIONATE D'",
    "ACETATE DE", "ACETATE D'", "ASCORBATE DE", "ASCORBATE D'", "BENZOATE DE", "BENZOATE D'", "BICARBONATE DE", "BICARBONATE D'",
    "BROMHYDRATE DE", "BROMHYDRATE D'", "CARBONATE DE", "CARBONATE D'", "CHLORHYDRATE D'", "CHLORHYDRATE DE", "CITRATE DE", "CITRATE D'",
    "FUMARATE DE", "FUMARATE D'", "GLUCONATE DE", "GLUCONATE D'", "LACTATE DE", "LACTATE D'", "MALEATE DE", "MALATE D'", "MALATE DE",
    "NITRATE DE", "NITRATE D'", "OXALATE DE", "OXALATE D'", "PHOSPHATE DE", "PHOSPHATE D'", "PROPIONATE DE", "PROPIONATE D'",
    "SUCCINATE DE", "SUCCINATE D'", "SULFATE DE", "SULFATE D'", "TARTRATE DE", "TARTRATE D'", "TOSILATE DE", "TOSYLATE DE",
)

# Salts, hydrates and solvates that end it.
SALT_SUFFIXES = (
    "MAGNESIQUE DIHYDRATE", "SODIQUE", "POTASSIQUE", "CALCIQUE", "MAGNESIQUE", "LITHIQUE", "ZINCIQUE", "MONOSODIQUE ANHYDRE", "MONOSODIQUE",
    "DISODIQUE", "DIPOTASSIQUE", "MONOPOTASSIQUE", "BASE", "DE SODIUM", "DE POTASSIUM", "DE CALCIUM", "DE MAGNESIUM", "ARGININE",
    "TERT-BUTYLAMINE", "TERT BUTYLAMINE", "ERBUMINE", "OLAMINE", "MAGNESIQUE TRIHYDRATE", "ANHYDRE", "HEMIPENTAHYDRATE", "HEMIPENTAHYDRAT",
    "HEMIHYDRATE", "MONOHYDRATE", "DIHYDRATE", "TRIHYDRATE", "PENTAHYDRATE", "SESQUIHYDRATE", "TOSILATE", "TERTBUTYLAMINE", "MALEATE",
    "CHLORHYDRATE", "SULFATE", "TARTRATE", "BESILATE", "MESILATE", "SUCCINATE", "FUMARATE", "OXALATE", "CITRATE", "ACETATE", "LACTATE",
    "VALERATE", "PROPIONATE", "BUTYRATE", "PHOSPHATE", "NITRATE", "BROMHYDRATE",
)

# What makes a final parenthesis a salt.
PARENTHESIS_SALTS = (
    "CHLORHYDRATE", "SULFATE", "MALEATE", "TARTRATE", "BESILATE", "MESILATE", "SUCCINATE", "FUMARATE", "OXALATE", "CITRATE", "ACETATE", "LACTATE",
    "VALERATE", "PROPIONATE", "BUTYRATE", "PHOSPHATE", "NITRATE", "BROMHYDRATE", "DE", "D'",
)

MINERALS = ("MAGNESIUM", "MAGNESIQUE", "SODIUM", "POTASSIUM", "CALCIUM", "MONOSODIQUE", "DISODIQUE", "ZINC")
INORGANIC_CORES = ("CHLORURE", "PHOSPHATE", "CARBONATE", "BICARBONATE", "SULFATE", "NITRATE", "HYDROXYDE", "OXIDE")
INORGANIC_MODIFIERS = ("MONOPOTASSIQUE", "DIPOTASSIQUE", "MONOSODIQUE", "DISODIQUE")
MINERAL_MODIFIERS = ("MONOSODIQUE", "DISODIQUE", "MONOPOTASSIQUE", "DIPOTASSIQUE", "MAGNESIQUE", "CALCIQUE")

# Forms that end a group label's brand, in order.
FALLBACK_FORMS = ("COMPRIME", "GELULE", "SOLUTION", "SUSPENSION", "POUDRE", "CREME", "POMMADE", "SIROP", "SUPPOSITOIRE", "INJECTABLE", "LYOPHILISAT")
NAME_STOPWORDS = ("POUR", "NOURRISSON", "ENFANT", "ADULTE", "SANS", "AVEC")

# Homeopathy: laboratories and words of names.
HOMEO_LABS = ("BOIRON", "LEHNING", "WELEDA")
HOMEO_WORDS = ("HOMEOPATHI", "DILUTION")

# Classes of forms, by the first keyword found in upper case; INJECT and radiopharmaceuticals go first.
GALENIC_CLASSES = (
    ("ORAL_SOLID", ("COMPRIME", "COMPRIMÉ", "GELULE", "GÉLULE", "CAPSULE", "PASTILLE", "LYOPHILISAT", "GRANULE", "POUDRE")),
    ("ORAL_LIQUID", ("SIROP", "SOL BUV", "SOLUTION BUVABLE", "GOUTTE", "GOUTTES", "SUSPENSION BUVABLE")),
    ("INJECTABLE", ("INJECTABLE", "PERFUSION", "SERINGUE", "IV", "IM", "SC", "INJECTION")),
    ("DERMAL", ("CREME", "CRÈME", "POMMADE", "GEL DERMIQUE", "DERMIQUE", "TOPIQUE", "LOTION", "SHAMPOOING")),
    ("OPHTHALMIC", ("COLLYRE", "OPHTALMIQUE", "OPH")),
    ("RESPIRATORY", ("INHALATION", "INHAL", "AEROSOL", "SPRAY", "POUDRE INHAL", "DISPOSITIF INHALATION")),
    ("NASAL", ("NASAL", "SPRAY NASAL", "GOUTTES NASALES")),
    ("RECTAL_VAGINAL", ("SUPPOSITOIRE", "OVULE", "RECTAL", "VAGINAL")),
    ("TRANSDERMAL", ("TIMBRE", "PATCH", "TRANSDERMIQUE")),
)

# Kinds of forms, by the first keyword found in lower case.
FORM_KINDS = (
    ("solid", ("comprim", "gelule", "gélule", "capsule")),
    ("liquid", ("sirop", "solution", "buvable")),
    ("semiSolid", ("creme", "crème", "pommade", "gel")),
    ("injectable", ("inject", "perf")),
)

# Forms that may follow a comma in a product label.
MASK_FORMS = (
    "comprim", "solution", "poudre", "degr", "suspension", "collyre", "gel", "capsule", "granul", "dispositif", "sirop", "pommade", "suppositoire",
    "gaz", "lyophilisat", "pastille", "dispersion", "ovule", "gomme", "vernis", "trousse", "liquide", "granules", "empl", "shampooing", "film", "microgranules",
)

# Forms that a grouping key leaves out.
GROUPING_FORMS = (
    "comprimé", "gélule", "solution", "injectable", "poudre", "sirop", "suspension", "crème", "pommade", "gel", "collyre", "inhalation",
    "orodispersible", "sublingual", "transdermique", "gingival", "pelliculé", "effervescent", "buvable",
)

# Parts of words that make a word a form, for telling forms from brands.
FORM_KEYWORDS = (
    "comprimé", "gélule", "solution", "injectable", "poudre", "sirop", "suspension", "crème", "pommade", "gel", "collyre", "inhalation", "orodispersible", "sublingual", "transdermique", "gingival", "pelliculé", "effervescent", "buvable", "enrobé",
    "dispersible", "sécable", "gastro-résistant", "lyophilisat", "capsule", "pastille", "bain", "bouche", "granulés", "sachet", "dose", "ampoule", "flacon", "perfusion", "vaginal", "rectal", "ovule", "suppositoire",
)

# Parts of texts that describe a formulation.
FORMULATION_KEYWORDS = (
    "édulcorée", "édulcoré", "édulcorer", "maltitol", "saccharine", "saccharose", "sucralose", "sans sucre", "sans lactose", "sans gluten", "au goût de", "arôme", "aromatisée", "liquide", "en poudre", "en solution", "rapport", "ratio", "proportion",
    "pour", "à", "et", "ou", "en sachet", "en flacon", "en ampoule", "adultes", "enfants", "nourrissons", "suspension buvable", "poudre pour", "solution pour", "molle", "sécable", "pelliculé", "enrobé", "dispositif", "système", "présentation",
)

# Words that a search index of keywords leaves out.
KEYWORD_STOPWORDS = ("COMPRIME", "GELULE", "SIROP", "SACHET", "DOSE", "FLACON", "MG", "ML", "BASE", "ANHYDRE")

# Spellings of commercial states, and how each is shown.
COMMERCIAL_STATES = {
    "active": ("en cours", "actif", "active", "current"),
    "revoked": ("abrogé", "abroge", "revoked", "annulé"),
    "not_marketed": ("non commercialisé", "non commercialise", "not marketed", "unmarketed"),
    "suspended": ("suspendu", "suspended", "pause"),
}
STATE_LABELS = {"active": "En cours", "revoked": "Abrogé", "not_marketed": "Non commercialisé", "suspended": "Suspendu", "unknown": "Inconnu"}
UNKNOWN_WORDS = ("unknown", "inconnu", "non spécifié", "non renseigné", "n/a", "nd", "-")
COMPANY_SUFFIXES = ("SAS", "SA", "SARL", "GMBH", "LTD", "INC")

# Homeopathy beyond laboratories and names.
HOMEO_MAKERS = ("LEHNING", "BOIRON", "HEEL", "WELEDA", "RECKEWEG", "UNDA", "LABORATOIRES HOMEOPATHIQU", "LABORATOIRES HOMEOPATHES")
HOMEO_TERMS = ("HOMÉOPATHIQU", "HOMEOPATH", "POUR PRÉPARATIONS", "GRANULES", "GLOBULES", "TRITURATION", "MOTHER TINCTURE", "TEINTURE MÈRE")
DILUTIONS = (r"\d+(?:CH|DH|K)", r"\b(?:CH|DH|K)\s*\d+\b", r"\b\d+LM\b", r"\b\d+M\b(?![GL])", r"\b\d+X\b", r"\b\d+CK\b", r"\b\d+Q\b")

# Minerals that keep a name of the form "mineral (salt DE)" for its salt.
ELECTROLYTES = ("SODIUM", "POTASSIUM", "CALCIUM", "MAGNESIUM", "LITHIUM", "ZINC", "FER", "CUIVRE")

# Rewrites of principles for the search index, each applied once and in this order: noise before salts are taken off,
# spellings after, and noise again.
PRINCIPLE_NOISE = (
    (r"^SOLUTION DE \s*", ""), (r"^CONCENTRAT DE \s*", ""), (r"\s*,?\s*FORME PULVERULENTE(?:,| \.)?$", ""),
    (r"\s*,?\s*LIQUIDE$", ""), (r"^(.*?)CONCENTRAT DE\s+", "$1"), (r",\s*FORME PULVERULENTE\s*$", ""), (r"^SOLUTION DE\s+", ""), (r",\s*SOLUTION DE\s*$", ""),
    (r"\s+BETADEX-CLATHRATE\s*$", ""), (r"\s+PROPYLENE GLYCOLATE\s*$", ""), (r"\s*\([^)]*\)\s*$", ""),
)
PRINCIPLE_SPELLINGS = (
    (r"^(.*?)CARBOCYSTEINE", "$1CARBOCISTEINE"), (r"^(.*?)SEVORANE", "$1SEVOFLURANE"), (r"^COLECALCIFEROL$", "CHOLECALCIFEROL"), (r"^(.*?)URSODESOXYCHOLIQUE", "$1URSODEOXYCHOLIQUE"),
    (r"^(.*?)CLAVULANATE", "$1CLAVULANIQUE"), (r"^(.*CLAVULAN.*?)\s+DE\s+POTASSIUM\s+DILUE\s*$", "$1"), (r"^CLAVULANIQUE.*$", "CLAVULANIQUE"),
    (r"^(.*?)CYAMEPROMAZINE", "$1CYAMEMAZINE"), (r"^(.*?)REMIFENTANYL", "$1REMIFENTANIL"), (r"^(.*?)VALPROIQUE", "$1VALPROATE"),
    (r"^(.*TRYPTOPHANE.*?)\s+L\s*$", "$1"), (r"^TRYPTOPHANE.*$", "TRYPTOPHANE"),
    (r"^(?=.*BENZYLIQUE)(.*?)DICHLORO-2,4", "$1DICHLORO"), (r"^(.*?)DICHLORO\s+BENZYLIQUE", "$1DICHLOROBENZYLIQUE"), (r"^PHOSPHATE MONOSODIQUE$", "PHOSPHATE"),
)
PRINCIPLE_LAST = (
    (r"^SOLUTION DE \s*", ""), (r"^CONCENTRAT DE \s*", ""), (r"\s*,?\s*FORME PULVERULENTE(?:,| \.)?\s*$", ""),
    (r"\s*,?\s*LIQUIDE\s*$", ""), (r"^(.*?)\(CONCENTRAT\s+DE\)", "$1"), (r"[,\s]+$", ""),
)

# First level of the ATC classification.
ATC_LEVEL_1 = {
    "A": "Système digestif", "B": "Sang", "C": "Système cardio-vasculaire", "D": "Dermatologie", "G": "Système génito-urinaire", "H": "Hormones",
    "J": "Anti-infectieux", "L": "Antinéoplasiques", "M": "Muscles et Squelette", "N": "Système nerveux", "P": "Antiparasitaires",
    "R": "Système respiratoire", "S": "Organes sensoriels", "V": "Divers",
}

# Routes of administration by group, and which group may be merged into which (from, to).
ROUTE_GROUPS = {
    "SYSTEMIC": ("ORALE", "SUBLINGUALE", "PER OS", "INTRAVEINEUSE", "INTRAMUSCULAIRE", "SOUS-CUTANEE", "RECTALE"),
    "LOCAL": ("CUTANEE", "DERMIQUE", "NASALE", "OPHTALMIQUE", "OTIQUE", "RECTALE", "VAGINALE"),
    "EXTERNAL": ("INHALATION", "TRANSDERMIQUE"),
}
ROUTE_MERGES = (("SYSTEMIC", "SYSTEMIC"), ("LOCAL", "LOCAL"), ("EXTERNAL", "EXTERNAL"), ("SYSTEMIC", "LOCAL"), ("LOCAL", "SYSTEMIC"), ("EXTERNAL", "LOCAL"))

# Conditions of prescription by flag, as patterns without case; states of availability by code.
PRESCRIPTION_FLAGS = {
    "LIST_1": r"liste\s+i\b", "LIST_2": r"liste\s+ii\b", "NARCOTIC": "stupéfiant", "HOSPITAL": "hospitalier",
    "DENTAL": "dentaire", "EXCEPTION": "d'exception", "RESTRICTED": "restreinte",
}
AVAILABILITY = {"1": "Rupture de stock", "2": "Tension d'approvisionnement", "3": "Arrêt de commercialisation", "4": "Remise à disposition"}
