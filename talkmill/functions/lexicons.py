"""Word lists, labels, markers and formats that results depend on."""

from __future__ import annotations

# --- fixed values: low-value text markers -----------------------------------
DELETED_MARKERS = [
    "[deleted]", "[removed]", "deleted", "removed", "comment deleted", "comment removed",
]
PROMOTIONAL_MARKERS = [
    "check out", "documenting the start", "http", "subscribe", "subscribed",
    "youtube.com/shorts", "like share", "check my channel", "visit my channel",
    "follow me", "giveaway", "promo code", "whatsapp", "telegram",
]
SOLICITATION_MARKERS = [
    "plz", "kalka dikao", "phone kodi", "please give", "please send", "please dedo",
    "please share", "dedo", "kudunga", "madi bro",
]
MOJIBAKE_MARKERS = ["Ã", "Â", "â", "ðŸ", "ï¸"]

# --- fixed values: script blocks and romanised marker words ------------------
SCRIPT_BLOCKS = {
    "hindi": ("\u0900", "\u097f"),
    "bengali": ("\u0980", "\u09ff"),
    "tamil": ("\u0b80", "\u0bff"),
    "telugu": ("\u0c00", "\u0c7f"),
    "malayalam": ("\u0d00", "\u0d7f"),
    "kannada": ("\u0c80", "\u0cff"),
    "gujarati": ("\u0a80", "\u0aff"),
    "gurmukhi": ("\u0a00", "\u0a7f"),
}
HINGLISH_MARKERS = [
    "acha", "accha", "bhai", "hai", "hain", "kya", "ka", "ki", "ke", "nahi", "nahin",
    "mat", "mast", "bahut", "bhot", "sahi", "paisa", "bekar", "jugaad", "yaar",
]
MALAYALAM_ROMAN_MARKERS = [
    "aanu", "alle", "chetta", "kollam", "nalla", "polichu", "sheri",
]

# --- fixed values: translator language codes ---------------------------------
LANGUAGE_CODES = {
    "english": "eng_Latn",
    "hindi": "hin_Deva",
    "hinglish": "hin_Deva",
    "arabic": "ara_Arab",
    "russian": "rus_Cyrl",
    "german": "deu_Latn",
    "french": "fra_Latn",
    "spanish": "spa_Latn",
    "malayalam": "mal_Mlym",
    "tamil": "tam_Taml",
    "kannada": "kan_Knda",
    "gujarati": "guj_Gujr",
    "mixed_malayalam_english": "mal_Mlym",
    "mixed_kannada_english": "kan_Knda",
    "mixed_tamil_english": "tam_Taml",
    "romanized_malayalam": "mal_Mlym",
}
SCRIPT_CODES = {
    "Cyrillic": "rus_Cyrl",
    "Arabic": "ara_Arab",
    "Devanagari": "hin_Deva",
    "Malayalam": "mal_Mlym",
    "Tamil": "tam_Taml",
    "Kannada": "kan_Knda",
    "Gujarati": "guj_Gujr",
}
# Scripts that compete for dominance but have no code.
UNCODED_SCRIPTS = ["Greek", "Hebrew", "Thai", "Hangul"]

# --- fixed values: annotation labels -----------------------------------------
SENTIMENT_LABELS = ["Positive", "Neutral", "Negative"]
ASPECT_LABELS = [
    "Gaming", "Display", "Battery", "Camera", "Performance", "Price", "Competition",
    "Purchase Intent", "Software", "Hardware", "Spam", "Support", "Other",
]
NOTE_LABELS = ["Ambiguous", "Future Demand", "Language Error", "Question", "Unrelated"]

# --- fixed values: rule-based sentiment words --------------------------------
# Scoring looks at single tokens, so only one-word entries are listed.
POSITIVE_WORDS = [
    "amazing", "awesome", "beautiful", "best", "better", "brilliant", "excellent",
    "fantastic", "favorite", "favourite", "good", "great", "happy", "impressive",
    "incredible", "love", "loved", "lovely", "nice", "perfect", "perfection",
    "recommend", "solid", "superb", "terrific", "wonderful", "worth", "worthy",
    "fast", "smooth", "sharp", "stunning", "gorgeous", "super", "amazed",
    "beast", "killer", "legend", "top", "king", "goat", "value", "underrated",
    "outstanding", "impressed", "pleased", "satisfied", "reliable", "durable",
    "convenient", "intuitive", "easy", "seamless", "flawless", "comfortable",
    "lightweight", "powerful", "efficient", "quality", "premium", "innovative",
    "gamechanger", "breakthrough", "upgrade", "improvement", "improved",
]
NEGATIVE_WORDS = [
    "bad", "worse", "worst", "terrible", "horrible", "awful", "poor", "garbage",
    "trash", "hate", "hated", "ugly", "junk", "broken", "useless", "pathetic",
    "disappointed", "disappointing", "disaster", "sucks", "suck", "crap", "shit",
    "overpriced", "expensive", "overrated", "underwhelming", "mediocre", "average",
    "slow", "lag", "laggy", "bug", "bugs", "buggy", "crash", "crashes", "freeze",
    "freezes", "glitch", "glitchy", "dreadful", "atrocious", "abysmal", "regret",
    "regretful", "mistake", "avoid", "ripoff", "scam", "fraud", "fault", "defective",
    "fail", "failed", "failure", "problem", "issue", "struggle", "unstable",
    "inconsistent", "unreliable", "fragile", "cheap", "flimsy", "noisy", "loud",
    "bulky", "heavy", "outdated", "obsolete", "boring", "dull", "annoying",
    "frustrating", "infuriating", "uncomfortable", "difficult", "confusing", "waste",
]
INTENSIFIERS = [
    "very", "really", "extremely", "incredibly", "unbelievably", "absolutely",
    "completely", "totally", "utterly", "highly", "so", "too", "super",
]
# Contracted negators contain an apostrophe and can never be a single [a-z]+ token.
NEGATORS = ["not", "no", "never", "neither", "nor", "cannot"]

# --- fixed values: competitor keywords ---------------------------------------
COMPETITOR_KEYWORDS = {
    "Steam Deck": [
        "rog ally", "asus rog", "ally x", "nintendo switch", "switch 2",
        "lenovo legion go", "legion go", "msi claw", "playstation", "ps5",
        "xbox", "onexplayer", "ayaneo", "gpd win",
    ],
    "Nintendo Switch": [
        "steam deck", "playstation", "ps5", "ps4", "xbox", "playstation 5",
        "rog ally", "lenovo legion go", "mobile", "android", "iphone",
    ],
    "Iphone 17": [
        "samsung", "galaxy", "pixel", "google pixel", "oneplus", "realme",
        "xiaomi", "vivo", "oppo", "iphone 16", "iphone 15", "16 pro",
        "15 pro", "14 pro",
    ],
}
DEFAULT_COMPETITORS = [
    "samsung", "nintendo", "playstation", "xbox", "ps5", "ps4", "rog ally",
    "legion go", "steam deck", "switch", "pixel", "oneplus", "xiaomi", "realme",
    "vivo", "oppo",
]

# --- fixed values: exploratory keyword groups --------------------------------
NEGATION_KEYWORDS = ["not", "never", "no"]
FEATURE_KEYWORDS = {
    "Display": ["oled", "screen", "display"],
    "Price": ["price", "expensive", "cheap", "cost"],
    "Gaming": ["games", "game", "mario", "gta"],
    "Competition": ["ps5", "xbox", "pc"],
    "Purchase Intent": ["buy", "want", "getting"],
}
FEATURE_POSITIVE = ["good", "great", "best", "love", "amazing", "awesome", "excellent"]
FEATURE_NEGATIVE = ["bad", "worst", "hate", "expensive", "poor", "issue", "problem"]

# --- fixed values: formats ---------------------------------------------------
WATCH_URL = "https://www.youtube.com/watch?v="
