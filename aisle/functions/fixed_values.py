"""Tables, constants and formats that results depend on.

They are inputs, not logic; every operator that uses one takes it as a
parameter with the value below as its default.
"""

# --- catalogue layout -------------------------------------------------------
TREE_SEPARATOR = " >> "
TREE_LEVELS = 4
TREE_MISSING = ["Other", "General", "General", "General"]
PRICE_COLUMNS = ["discounted_price", "retail_price", "price"]
RATING_COLUMNS = ["product_rating", "overall_rating", "rating"]
COLOR_KEYS = ["color", "colour", "shade"]
MATERIAL_KEYS = ["material", "fabric", "composition"]
SIZE_KEYS = ["size", "dimensions", "size_range"]
MAX_FEATURES = 10
CURRENCY = "₹"

# Cell texts that a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

CLEAN_COLUMNS = [
    "product_name", "description", "features", "tags", "brand", "keywords",
    "department", "category", "subcategory", "product_type",
]
FILL_DEFAULTS = {
    "department": "Other",
    "category": "General",
    "subcategory": "General",
    "product_type": "General",
    "description": "",
    "features": "",
    "brand": "Unknown",
    "color": "",
    "material": "",
    "size_range": "",
    "tags": "",
    "keywords": "",
    "stock_status": "In Stock",
}

# --- text -------------------------------------------------------------------
# Sales phrases removed from descriptions and features, longest first.
BOILERPLATE_PATTERNS = [
    r"buy\s+.*?\s+(?:online|for\s+rs\.?\s*[\d,]+(?:\.\d+)?)",
    r"only\s+for\s+rs\.?\s*[\d,]+(?:\.\d+)?",
    r"price\s*[:\-]?\s*rs\.?\s*[\d,]+(?:\.\d+)?",
    r"at\s+best\s+price[s]?",
    r"from\s+{site}",
    r"on\s+{site}",
    r"{site}",
    r"only\s+genuine\s+products?\.?",
    r"30\s*day\s+replacement\s+guarantee\.?",
    r"free\s+shipping\.?",
    r"cash\s+on\s+delivery\.?",
    r"\bcod\b",
    r"key\s+features\s+of\s+[^:.,]*[:.,]",
    r"specifications?\s+of\s+[^:.,]*[:.,]",
    r"general\s+in\s+the\s+box\s+[^:.,]*[:.,]?",
    r"\(pack\s+of\s+\d+\)",
]
SHOP_SITE = r"[a-z0-9-]+\.com"
SKU_MIN_LEN = 10

EXTRA_STOPWORDS = [
    "product", "item", "buy", "best", "good", "great",
    "need", "want", "looking", "find", "search",
]
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

CODE_MIXED_WORDS = {
    "accha": "good",
    "sasta": "cheap",
    "mehenga": "expensive",
    "kapde": "clothes",
    "joote": "shoes",
    "phone": "phone",
    "ghar": "home",
    "khana": "food",
    "paani": "water",
    "sundar": "beautiful",
    "mazboot": "strong durable",
    "aaram": "comfortable",
    "naya": "new",
    "purana": "old",
    "bada": "big large",
    "chhota": "small",
    "safed": "white",
    "kala": "black",
    "lal": "red",
    "neela": "blue",
    "peela": "yellow",
    "hara": "green",
    "badhiya": "excellent quality",
    "tikau": "durable",
    "halka": "lightweight",
    "kamra": "room",
    "rasoi": "kitchen",
    "bistar": "bed bedding",
    "kurta": "kurta ethnic wear",
    "saree": "saree ethnic wear",
    "jeans": "jeans denim",
    "tshirt": "t-shirt",
}

# --- enrichment -------------------------------------------------------------
TEMPLATES = {
    "Clothing": (
        "{product_name} is a premium {product_type} designed for {use_case}. "
        "Made from {material_text}, this {category} item offers exceptional comfort "
        "and style. {features_text} Available in {color_text}, it pairs well with "
        "various outfits for {occasion}. The {brand} brand is known for quality "
        "craftsmanship and attention to detail. {size_text} Whether you're looking "
        "for everyday wear or something special, this {subcategory} piece delivers "
        "on both aesthetics and functionality. Perfect for {target_audience} who "
        "value {value_proposition}. Rated {rating}/5 by customers."
    ),
    "Electronics": (
        "{product_name} is a cutting-edge {product_type} from {brand}. "
        "Featuring {features_text}, this {category} device is designed for "
        "{use_case}. {description_text} With advanced technology and reliable "
        "performance, it stands out in the {subcategory} segment. {specs_text} "
        "Ideal for {target_audience} seeking {value_proposition}. "
        "Rated {rating}/5 stars by verified buyers. Priced at {price_text}."
    ),
    "default": (
        "{product_name} — a top-rated {product_type} from {brand}. "
        "Category: {category} > {subcategory}. {description_text} "
        "Key features include {features_text}. {color_text} {material_text} "
        "{size_text} This product has earned {rating}/5 stars and is priced "
        "at {price_text}. Ideal for {use_case}. {tags_text}"
    ),
}
PADDING_TEMPLATE = (
    " This {product_type} is perfect for {use_case}. From the trusted {brand} "
    "brand, it delivers excellent value. Highly rated by customers at "
    "{rating}/5 stars. Part of the {category} collection in our {department} "
    "department. {tags_text}"
)
MIN_WORDS = 50
USE_CASES = {
    "Clothing": "daily wear, office settings, and casual outings",
    "Footwear": "walking, running, and everyday comfort",
    "Electronics": "home entertainment, productivity, and connectivity",
    "Furniture": "home decoration, comfort, and space optimization",
    "Kitchen": "cooking, food preparation, and kitchen efficiency",
    "Beauty": "personal care, skincare, and grooming routines",
    "Sports": "fitness activities, training, and outdoor adventures",
    "Books": "reading, learning, and personal development",
    "Automotive": "vehicle maintenance, upgrades, and driving comfort",
    "Baby": "infant care, comfort, and safety",
    "default": "various everyday needs",
}
OCCASIONS = {
    "Clothing": "casual outings, formal events, and everyday activities",
    "Footwear": "sports, office wear, and weekend outings",
    "default": "various occasions and daily use",
}
AUDIENCES = {
    "Clothing": "fashion-conscious individuals",
    "Electronics": "tech enthusiasts and everyday users",
    "default": "discerning shoppers seeking quality products",
}
SLOT_TEXTS = {
    "features_missing": "quality construction and reliable performance",
    "color": "Available in %s.",
    "material": "Crafted from %s.",
    "material_missing": "high-quality materials",
    "size": "Available sizes: %s.",
    "price_missing": "competitive pricing",
    "tags": "Related: %s.",
    "value_proposition": "quality, style, and value",
}

# --- query expansion --------------------------------------------------------
INTENT_EXPANSIONS = {
    "mens tshirt": "men men's clothing t-shirt tshirt tee round neck polo neck",
    "men tshirt": "men men's clothing t-shirt tshirt tee round neck polo neck",
    "men t-shirt": "men men's clothing t-shirt tshirt tee round neck polo neck",
    "mens t-shirt": "men men's clothing t-shirt tshirt tee round neck polo neck",
    "men tee": "men men's clothing t-shirt tshirt tee",
    "for men tshirt": "men men's clothing t-shirt tshirt tee",
    "watch movies": "television tv led lcd smart monitor home theatre projector",
    "watch videos": "television tv monitor tablet laptop projector",
    "listen to music": "headphone earphone speaker bluetooth headset audio",
    "listen music": "headphone earphone speaker bluetooth headset audio",
    "take pictures": "camera dslr mirrorless lens photography smartphone",
    "take photos": "camera dslr mirrorless lens photography",
    "record video": "camera camcorder gopro action camera dslr",
    "play games": "gaming console controller joystick gamepad",
    "read book": "kindle ereader tablet",
    "read digitally": "kindle ereader tablet",
    "cook food": "cookware pan pot kitchen utensil knife",
    "prepare food": "cookware pan pot kitchen utensil knife chopping board",
    "store food": "container jar storage box airtight",
    "clean clothes": "washing machine detergent laundry",
    "wash clothes": "washing machine detergent laundry",
    "stay cool": "air conditioner fan cooler",
    "stay warm": "heater blanket jacket sweater",
    "sleep better": "bed mattress pillow bedsheet",
    "work out": "gym fitness dumbbell yoga mat treadmill sports",
    "exercise": "gym fitness dumbbell yoga mat treadmill sports shoes",
    "run outdoors": "running shoes sports shoes athletic footwear",
    "walk comfortably": "shoes sneakers footwear casual",
    "carry laptop": "laptop bag backpack messenger",
    "carry things": "bag backpack handbag tote",
    "keep money": "wallet purse cardholder",
    "organize money": "wallet purse cardholder",
    "wear to office": "formal shirt trouser blazer tie formal shoe",
    "wear to work": "formal shirt trouser blazer tie formal shoe",
    "wear casually": "t-shirt jeans casual shirt",
    "feet for exercise": "sports shoes running shoes athletic footwear",
    "on my feet": "shoes footwear sneakers sandal",
    "for my daughter": "girls kids children",
    "for my son": "boys kids children",
    "for my baby": "baby infant toddler",
    "for kids": "kids children boys girls",
    "charge phone": "mobile charger power bank cable adapter",
    "cut hair": "trimmer shaver clipper",
    "shave": "trimmer shaver razor",
    "protect phone": "mobile case cover screen guard tempered glass",
    "smell good": "perfume deodorant cologne fragrance",
    "look good": "cosmetics makeup beauty skincare",
}

# --- shopper intent ---------------------------------------------------------
QUERY_MEN = r"\b(men|mens|men's|male|gents|gentlemen|boy)\b"
QUERY_WOMEN = r"\b(women|womens|women's|female|ladies|girl)\b"
QUERY_TSHIRT = r"\b(t[\s\-]?shirt|tee|tees)\b"
KIDS = r"\b(kid|kids|child|children|boy|girl|infant|baby|toddler)\b"
RESULT_MEN = r"\b(men|men's|mens|male|gents|boy)\b"
RESULT_WOMEN = r"\b(women|women's|womens|female|ladies|girl)\b"
RESULT_TSHIRT = r"\b(t[\s\-]?shirt|tee|polo neck|round neck)\b"
RESULT_BRA = r"\bbra\b"
INTENT_FACTORS = {
    "wrong_gender": 0.35,
    "right_gender": 1.20,
    "unwanted_kids": 0.60,
    "unwanted_bra": 0.30,
    "wanted_tshirt": 1.15,
}

# --- ranking ----------------------------------------------------------------
HIERARCHICAL = "model1_hierarchical"
FLAT = "model2_flat_semantic"
ENHANCED = "model3_enhanced"
EXPANDED = "model4_llm"
ENSEMBLE = "ensemble"
MODELS = [HIERARCHICAL, FLAT, ENHANCED, EXPANDED]
ENSEMBLE_WEIGHTS = {HIERARCHICAL: 0.20, FLAT: 0.20, ENHANCED: 0.35, EXPANDED: 0.25}
RERANK_WEIGHTS = {
    "semantic_similarity": 0.85,
    "rating_score": 0.05,
    "reviews_score": 0.02,
    "price_relevance": 0.03,
    "stock_bonus": 0.05,
}
REVIEWS_FULL_SCORE = 1000
PRICE_FULL_SCORE = 10000
PRICE_MISSING_SCORE = 0.3
OUT_OF_STOCK_SCORE = 0.2
LEVEL_DECAY = 0.85
BEAM_WIDTHS = {1: 5, 2: 5, 3: 5, 4: 3}
OVERFETCH = 5
CONSTRAINED_OVERFETCH = 8
ENSEMBLE_OVERFETCH = 2
MAX_TOP_K = 50
MAX_QUERY_CHARS = 500
RESULT_DESCRIPTION_CHARS = 200

# --- vectors ----------------------------------------------------------------
EMBEDDING_DIM = 384
ENCODE_BATCH = 256
IVF_PROBES = 10
