"""Word lists of the rules. They decide results and must stay as they are."""

# Canonical classifier
PAYROLL = [
    "payroll", "salary", "wages", "direct dep", "direct deposit",
    "pay from", "paycheck", "adp", "paychex", "gusto", "workday",
    "quickbooks payroll", "zenefits",
]
TRANSFER = [
    "transfer", "xfer", "ach", "wire", "zelle", "venmo", "paypal",
    "cash app", "cashapp", "apple cash", "square cash",
]
BANK = [
    "chase", "wells fargo", "bank of america", "bofa", "citi", "citibank",
    "capital one", "us bank", "pnc", "td bank", "ally", "discover",
    "american express", "amex", "barclays", "synchrony",
]
BANK_DIRECTION = ["transfer", "to", "from"]
CARD_PAYMENT = [
    "payment thank you", "autopay", "online payment", "payment received",
    "credit card payment", "cc payment",
]
REFUND = [
    "refund", "credit", "return", "reversal", "chargeback",
    "adjustment", "rebate", "cashback",
]

# Transfer pairing (wider lists than the classifier)
PAIR_TRANSFER = TRANSFER + ["wisely", "online banking transfer", "mobile deposit"]
PAIR_BANK = BANK + [
    "marcus", "fidelity", "schwab", "vanguard", "betterment", "wealthfront",
    "savings", "checking", "brokerage",
]
PAIR_CARD_PAYMENT = CARD_PAYMENT + ["automatic payment"]

# Refund matching
MATCH_REFUND = [
    "refund", "credit", "return", "reversal", "chargeback",
    "adjustment", "rebate", "reimbursement", "cashback",
]

# Pattern mining and the five-label classifier
PATTERN_TRANSFER = [
    "credit card", "card payment", "cc payment",
    "payment to chase", "payment to citi", "payment to amex",
    "payment to american express", "payment to discover",
    "payment to capital one", "payment to bank of america",
    "payment to wells fargo", "payment to usaa",
    "bill pay", "autopay", "transfer to", "transfer from",
    "ach transfer", "internal transfer", "zelle", "venmo", "cash app",
]
CREDIT_TRANSFER = [
    "transfer from", "transfer to", "online transfer", "recurring transfer",
    "ach transfer", "wire transfer", "zelle", "venmo", "cash app", "paypal",
]
STRONG_INCOME = [
    "payroll", "paycheck", "direct deposit", "direct dep", "salary", "wages",
    "unemployment", "irs", "tax refund", "ssa ", "social security", "pension",
    "disability", "edd ", "employer",
]
CARD_PAYMENT_OUT = [
    "payment to chase", "payment to citi", "payment to amex",
    "payment to american express", "payment to discover",
    "payment to capital one", "payment to bank of america",
    "payment to wells fargo", "payment to usaa", "payment to barclays",
    "credit card payment", "card payment", "cc payment",
]
CARD_NAME = [
    "credit card", "visa", "mastercard", "amex", "american express", "discover",
    "chase sapphire", "chase freedom", "capital one", "citi", "barclays",
    "wells fargo active cash", "rewards",
]
NOT_CARD_NAME = ["checking", "savings", "money market", "debit", "ira", "401k", "brokerage"]

# Pattern classes
UTILITY = [
    "electric", "power", "energy", "water", "sewage", "utility", "utilities",
    "city of", "municipal", "comcast", "xfinity", "at&t", "att", "verizon",
    "spectrum", "cox", "internet", "fiber", "frontier", "centurylink",
]
DEBT = ["mortgage", "loan", "lending", "student loan", "auto loan", "car loan"]
INSURANCE = [
    "insurance", "geico", "state farm", "allstate", "progressive",
    "liberty mutual", "usaa", "farmers", "nationwide", "aetna",
    "cigna", "united health", "blue cross", "humana",
]
SUBSCRIPTION = [
    "netflix", "spotify", "hulu", "disney", "hbo", "max", "paramount",
    "peacock", "apple tv", "prime video", "crunchyroll", "youtube",
    "audible", "kindle", "apple music", "amazon music", "pandora", "tidal",
    "icloud", "google one", "dropbox", "onedrive",
    "adobe", "microsoft 365", "office 365", "github", "chatgpt", "openai",
    "notion", "1password", "lastpass", "dashlane",
    "linkedin", "coursera", "udemy", "skillshare", "masterclass", "duolingo",
    "xbox", "playstation", "nintendo", "steam", "ea play",
    "nytimes", "washington post", "wsj", "medium", "substack",
    "peloton", "planet fitness", "la fitness", "gold's gym", "gym", "fitness",
    "strava", "fitbit", "patreon", "twitch", "discord", "grammarly", "canva",
    "vpn", "nordvpn", "expressvpn",
]
FINANCE = ["bank", "credit", "card", "chase", "citi", "wells", "capital one"]
STABLE_SUBSCRIPTION = [
    "netflix", "spotify", "hulu", "disney", "hbo", "youtube",
    "apple", "amazon prime", "adobe", "microsoft", "dropbox",
    "patreon", "github", "audible", "kindle", "gym", "fitness",
    "peloton", "strava", "medium", "substack",
]
INSURANCE_OR_PREMIUM = INSURANCE + ["premium"]

# Labels left out of strict subscription candidates
NOISE = [
    "payment", "bill pay", "autopay", "transfer", "ach transfer", "zelle",
    "venmo", "cash app", "mortgage", "loan", "escrow", "principal",
    "interest", "credit card", "cc payment",
]

# Income suggestions without user rules
SUGGEST_INCOME = ["payroll", "direct deposit", "paycheck", "salary"]

# Overlapping services: duplicate groups, monthly alerts, bundle check
DUPLICATE_FAMILIES = {
    "Disney Bundle": ["disney", "hulu", "espn"],
    "Apple": ["apple", "icloud", "itunes", "app store", "apple tv", "apple music"],
    "Amazon": ["amazon prime", "prime video", "audible", "kindle", "amazon music"],
    "Google": ["google", "youtube", "google one", "google play"],
    "Microsoft": ["microsoft", "xbox", "office 365", "microsoft 365", "game pass"],
    "Streaming": ["netflix", "hbo", "max", "paramount", "peacock", "showtime"],
}
ALERT_FAMILIES = {
    "disney_bundle": ["disney", "hulu", "espn"],
    "apple": ["apple", "icloud", "itunes", "app store"],
    "amazon": ["amazon prime", "prime video", "audible", "kindle"],
    "google": ["google", "youtube"],
    "microsoft": ["microsoft", "xbox", "office 365"],
}
BUNDLE_FAMILIES = {
    "disney_bundle": ["disney", "hulu", "espn"],
    "apple": ["apple", "icloud", "app store"],
    "amazon": ["amazon", "prime"],
    "google": ["google", "youtube"],
    "microsoft": ["microsoft", "xbox", "office"],
    "netflix": ["netflix"],
    "spotify": ["spotify"],
}
