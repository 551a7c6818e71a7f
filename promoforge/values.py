"""Fixed values of the offer domain. They must stay exactly as they are for results to match."""

from __future__ import annotations

# Category id and label, in display order.
CATEGORIES = (
    ("carne", "Carne e pollame"),
    ("salumi", "Salumi"),
    ("pesce", "Pesce"),
    ("frutta_verdura", "Frutta e verdura"),
    ("latticini_uova", "Latticini e uova"),
    ("pane_forno", "Pane e forno"),
    ("pasta_riso_cereali", "Pasta, riso e cereali"),
    ("dispensa", "Dispensa e condimenti"),
    ("piatti_pronti", "Piatti pronti e alternative vegetali"),
    ("dolci", "Dolci e snack dolci"),
    ("snack_salati", "Snack salati"),
    ("bevande", "Bevande"),
    ("casa_pulizia", "Casa e pulizia"),
    ("cura_persona", "Cura della persona"),
    ("infanzia", "Infanzia"),
    ("animali", "Animali"),
    ("non_alimentare", "Non alimentare"),
    ("altri", "Altri prodotti"),
)
FALLBACK_CATEGORY = "altri"
CLASSIFICATION_VERSION = "6"

# Ordered title rules (rule id, category, pattern); the first match decides.
TITLE_RULES = (
    ("pet-purina-gourmet", "animali", r"\bpurina gourmet\b"),
    ("ready-macaroni", "piatti_pronti", r"\bmaccheroni con speck\b"),
    ("sliced-cooked-turkey", "salumi", r"\btacchino al forno a fette\b"),
    ("cordon-bleu", "piatti_pronti", r"\bcordon bleu\b"),
    ("milk-chocolate", "dolci", r"\bcioccolato (?:finissimo )?al latte\b"),
    ("cheese-corn-snack", "snack_salati", r"\bcornetti di mais\b"),
    ("puff-pastry", "pane_forno", r"\bpasta sfoglia\b"),
    ("lettuce-hearts", "frutta_verdura", r"\b(?:cuori di lattuga|cuori di riccia|kiwi verdi)\b"),
    ("named-cheeses", "latticini_uova", r"\b(?:mozzarelle|emmental|pecorino|squaquerello|sottilette)\b"),
    (
        "wine-varieties",
        "bevande",
        r"\b(?:cabernet|sauvignon|lambrusco|chianti|merlot|chardonnay|sangiovese|prosecco|gin)\b",
    ),
    ("seafood-octopus", "pesce", r"\b(?:polpo|filetti di alici|misto mare)\b"),
    ("breakfast-buondi", "dolci", r"\bbuondi\b"),
    ("pesto", "dispensa", r"\bpesto con basilico\b"),
    ("house-detergent", "casa_pulizia", r"\bdetergente (?:pavimenti|per wc)\b"),
    ("baby-food", "infanzia", r"\bomogeneizzat[oi]\b"),
    ("sliced-poultry", "salumi", r"\baffettati\b.*\b(?:pollo|tacchino)\b"),
    ("prepared-pizza", "piatti_pronti", r"\bpizza\b"),
    ("plant-kebab", "piatti_pronti", r"\bkebab\b.*\bvegetale\b"),
    ("stuffed-pasta", "pasta_riso_cereali", r"\b(?:tortellini|tortelloni|ravioli)\b"),
    ("mashed-potatoes", "piatti_pronti", r"\bpure[’']? di patate\b"),
    ("baby-diapers", "infanzia", r"\bpampers baby[ -]?dry\b"),
    ("sliced-turkey", "salumi", r"\barrosto di tacchino\b"),
    ("bacon-speck", "salumi", r"\b(?:bacon|speck|spianata piccante)\b"),
    (
        "sweet-bakery",
        "dolci",
        r"\b(?:pancakes?|wafer|wafers|crostata|ciambelle zuccherate|cannoli|tortina|cookie)\b",
    ),
    ("rusks", "pane_forno", r"\bfette biscottate\b"),
    ("breakfast-grains", "pasta_riso_cereali", r"\b(?:fiocchi di avena|granola)\b"),
    ("pasta-shapes", "pasta_riso_cereali", r"\b(?:orecchiette|trofie|strozzapreti)\b"),
    ("tomato-passata", "dispensa", r"\b(?:passata di pomodoro|sugo pronto|pinoli)\b"),
    ("personal-soap", "cura_persona", r"\bsapone liquido\b"),
    ("cleansing-paste", "cura_persona", r"\bpasta lavamani\b"),
    ("pickled-cabbage", "dispensa", r"\bcrauti\b"),
    ("cooked-sausage", "salumi", r"\bwurstel\b"),
    ("ambiguous-trancino", "altri", r"\btrancino\b"),
    ("savory-bakery", "pane_forno", r"\b(?:focaccia|pagnotta)\b"),
    ("vinegar", "dispensa", r"\baceto\b"),
    ("coconut-milk", "dispensa", r"\blatte di cocco\b"),
    ("pretzel", "snack_salati", r"\bpretzel\b"),
    ("prepared-side", "piatti_pronti", r"\bcontorno di\b"),
    (
        "prepared-meal",
        "piatti_pronti",
        r"\b(?:arancini|mini toast|panzerotti|polpette di maccheroni|burger vegetale)\b",
    ),
    ("pet-food", "animali", r"\b(?:gatti|gatto|cani|cane|lettiera)\b"),
    ("chocolate-egg", "dolci", r"\buov[oa] di cioccolato\b"),
    ("cleansing-milk", "cura_persona", r"\blatte detergente\b"),
    ("plant-burger", "piatti_pronti", r"\bburger vegetal[ei]\b"),
    ("cooked-turkey", "salumi", r"\bpetto di tacchino (?:arrosto|al forno)\b"),
    (
        "cured-meat",
        "salumi",
        r"\b(?:salamini|salame|porchetta|pancetta arrotolata|prosciutto crudo|prosciutto cotto|bresaola)\b",
    ),
)

# Source category segment to category.
SOURCE_CATEGORIES = {
    "CARNI": "carne",
    "ORTOFRUTTA": "frutta_verdura",
    "BEVANDE": "bevande",
    "CURA PERSONA": "cura_persona",
    "CURA CASA": "casa_pulizia",
    "PETCARE": "animali",
    "Carne e pollame": "carne",
    "Carne di manzo": "carne",
    "Carne di maiale": "carne",
    "Pesce": "pesce",
    "Frutta": "frutta_verdura",
    "Verdura": "frutta_verdura",
    "Dolci": "dolci",
    "Prodotti per animali": "animali",
}

# Ordered generic keywords (category, pattern); the first match decides.
KEYWORD_RULES = (
    ("salumi", r"\b(?:salame|prosciutto|bresaola|mortadella|pancetta|wurstel|lonzino)\b"),
    ("carne", r"\b(?:pollo|tacchino|bovino|scottona|suino|salsiccia|manzo|hamburger)\b"),
    ("pesce", r"\b(?:pesce|salmone|merluzzo|tonno|gamberi|orata|branzino|vongole|cozze)\b"),
    ("cura_persona", r"\b(?:shampoo|dentifricio|bagnoschiuma|deodorante|crema viso)\b"),
    ("infanzia", r"\b(?:pannolini|omogeneizzato)\b"),
    (
        "casa_pulizia",
        r"\b(?:lavatrice|detersivo|ammorbidente|carta igienica|asciugatutto|swiffer|candeggina)\b",
    ),
    (
        "latticini_uova",
        r"\b(?:latte|uova|uovo|yogurt|formaggio|mozzarella|burro|mascarpone|panna|grana|latticino|fermenti|grattugiato|stracchino|albume)\b",
    ),
    (
        "dolci",
        r"\b(?:biscotti|frollini|cioccolato|cioc|gelato|gelati|torta|croissant|milk snack|crema alla nocciola|merendine)\b",
    ),
    ("snack_salati", r"\b(?:patatine|taralli|cracker|salatini)\b"),
    ("piatti_pronti", r"\b(?:vellutata|zuppa|burger vegetale|lasagne|pizza)\b"),
    (
        "pasta_riso_cereali",
        r"\b(?:pasta|spaghetti|riso|fusilli|penne|cereali|cavatelli|scialatielli)\b",
    ),
    ("pane_forno", r"\b(?:pane|piadina|pinsa|panini)\b"),
    ("bevande", r"\b(?:acqua|birra|vino|cola|limonata|succo|bibita)\b"),
    (
        "dispensa",
        r"\b(?:olio|aceto|maionese|ragu|fagioli|miele|farina|caffe|zucchero|sale|olive|carciofini|polpa di pomodoro|confettura)\b",
    ),
    (
        "frutta_verdura",
        r"\b(?:mele|pere|uva|banane|cipolle|zucchine|carote|insalata|patate|pomodori|peperoni)\b",
    ),
    (
        "non_alimentare",
        r"\b(?:scarpa|scarpe|pigiama|serra|scaffale|ferro da stiro|scala|sgabello|lanterna|pianta artificiale|telo|pensilina|stiratrice|pantaloni|tappeto|calzini)\b",
    ),
)

# Dietary evidence (substring of the normalised evidence, tag), in tag order.
DIETARY_TAGS = (
    ("surgelat", "Surgelato"),
    ("biologico", "Biologico"),
    ("senza glutine", "Senza glutine"),
    ("senza lattosio", "Senza lattosio"),
    ("vegetale", "Vegetale"),
)

# Italian month names, January first, and weekday names after normalisation.
MONTHS = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
)
WEEKDAYS = ("lunedi", "martedi", "mercoledi", "giovedi", "venerdi", "sabato", "domenica")

# Flags of the embedded-array profile that must all be exactly false.
ARRAY_MECHANICS = (
    "x32", "secondo50", "menoSpendi", "scontiInFesta", "acquistominimo", "pezzi2euro1",
    "piu1", "piu_1_1", "piu_2_1", "piu_3_1", "per_3_2", "piu_3_2",
)
# Flags of the embedded-array profile that state a dietary tag.
ARRAY_TAG_FLAGS = (
    ("glutenFree", "Senza glutine"),
    ("lactFree", "Senza lattosio"),
    ("bio", "Biologico"),
    ("surgelato", "Surgelato"),
)

# Time limits in seconds.
STALE_SECONDS = 43_200
HIDDEN_SECONDS = 172_800
ABSENCE_SPACING_SECONDS = 1_800
ABSENCES_TO_WITHDRAW = 2
# Collapse guard.
COLLAPSE_MIN_PREVIOUS = 20
COLLAPSE_RATIO = 0.25
# Selection, retention and snapshot limits.
MAX_TARGETS = 5
RETENTION_BYTES = 500 * 1024 * 1024
RETENTION_SECONDS = 7 * 86_400
SNAPSHOT_BYTES = 10 * 1024 * 1024
SNAPSHOT_RECORDS = 10_000
SNAPSHOT_VERSION = 1

TIMEZONE = "Europe/Rome"
OFFER_TYPES = ("product_offer", "product_coupon", "basket_coupon", "future_voucher", "loyalty_benefit")
PRODUCT_TYPES = ("product_offer", "product_coupon")
QUALITIES = ("publishable", "limited", "quarantined")
PRICE_BASES = ("pack", "kg", "l", "piece", "bundle", "from", "unknown")
CONNECTORS = (
    "attribute_json", "card_grid", "js_array", "rect_cells", "store_paged", "rule_grid", "voucher",
)
ADMITTED_AUDITS = ("partial", "verified_supported")
