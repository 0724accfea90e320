"""Spending categories and the text rules that pick them.

Fixed values: rule text, category and confidence, in rule order.
The highest confidence wins, the earlier rule on a tie.
"""

CATEGORIES = [
    "income", "one_time_deposit", "housing", "debt_payment", "utilities", "groceries",
    "dining", "transport", "entertainment", "shopping", "health", "insurance",
    "subscriptions", "travel", "education", "personal", "pets", "gifts", "fees",
    "transfer", "other",
]

# A positive row whose text falls in one of these is a refund of that category.
REFUNDABLE = [
    "dining", "groceries", "transport", "shopping", "entertainment",
    "health", "utilities", "travel", "personal", "home", "education",
    "subscriptions", "insurance", "fees", "gifts", "pets",
]

# Left out of spending breakdowns.
NOT_SPENDING = ["income", "transfer", "one_time_deposit"]

CATEGORY_RULES = [
    (r"(payroll|direct deposit|paycheck|salary|unemployment)", "income", 0.95),
    (r"(refund|rebate|cashback|cash back|reimbursement|reimburse)", "one_time_deposit", 0.9),
    (r"(sold|sale proceeds|ebay|poshmark|mercari|offerup|craigslist)", "one_time_deposit", 0.85),
    (r"(insurance claim|insurance payout|settlement)", "one_time_deposit", 0.9),
    (r"(gift|inheritance|bonus|award|prize|lottery|winnings)", "one_time_deposit", 0.85),
    (r"(tax refund|irs treas|state tax)", "one_time_deposit", 0.9),
    (r"(returned|credit|adjustment|reversal)", "one_time_deposit", 0.7),
    (r"(rent|lease|apartment|property|hoa|homeowner)", "housing", 0.9),
    (r"(mortgage|home loan|mtg pmt)", "debt_payment", 0.95),
    (r"(loan|lending|student loan|auto loan|car loan|personal loan)", "debt_payment", 0.95),
    (r"(credit card|card payment|card pmt|payment.*thank)", "debt_payment", 0.95),
    (r"(chase card|citi card|discover card|capital one card|amex|american express)", "debt_payment", 0.95),
    (r"(bank of america|wells fargo|synchrony|barclays).*(payment|pmt)", "debt_payment", 0.9),
    (r"(payment to|pmt to|pay to).*bank", "debt_payment", 0.85),
    (r"(electric|power|natural gas|gas bill|gas co\b|one gas|water|sewage|trash|waste|utility|utilities)", "utilities", 0.9),
    (r"(comcast|xfinity|at&t|verizon|t-mobile|spectrum|cox|centurylink|google fiber)", "utilities", 0.9),
    (r"(city of \w+)(?!.*\b(hall|limit|cashless|parking|airport)\b)", "utilities", 0.85),
    (r"(internet|cable|phone|wireless|mobile|telecom)", "utilities", 0.8),
    (r"(grocery|groceries|supermarket|whole foods|trader joe|kroger|safeway|publix|aldi|costco|sam's club|walmart supercenter|target)", "groceries", 0.9),
    (r"(h-e-b|heb|wegmans|food lion|giant|stop.?shop|sprouts|meijer)", "groceries", 0.9),
    (r"(restaurant|cafe|coffee|starbucks|dunkin|mcdonald|burger|pizza|taco|chipotle|subway|panera|chick-fil-a|wendy)", "dining", 0.9),
    (r"(doordash|uber eats|ubereats|grubhub|postmates|seamless|caviar)", "dining", 0.95),
    (r"(bar|pub|brewery|tavern|grill)", "dining", 0.8),
    (r"(uber|lyft|taxi|cab|transit|metro|bus|train|amtrak|parking)", "transport", 0.9),
    (r"(gas station|shell|chevron|exxon|mobil|bp\b|arco|76 gas|76 station|speedway|wawa)", "transport", 0.9),
    (r"(car wash|auto|tire|oil change|mechanic|jiffy lube)", "transport", 0.85),
    (r"(toll|dmv|registration)", "transport", 0.8),
    (r"(netflix|hulu|disney|hbo|paramount|peacock|apple tv|amazon prime video|spotify|pandora|youtube|twitch)", "entertainment", 0.95),
    (r"(movie|cinema|theater|theatre|amc|regal)", "entertainment", 0.9),
    (r"(game|playstation|xbox|steam|nintendo|epic games)", "entertainment", 0.9),
    (r"(concert|ticket|ticketmaster|stubhub|eventbrite|live nation)", "entertainment", 0.85),
    (r"(amazon(?! prime video)|walmart|target|best buy|home depot|lowe's|ikea|wayfair)", "shopping", 0.8),
    (r"(ebay|etsy|wish|aliexpress|shein)", "shopping", 0.85),
    (r"(clothing|apparel|shoes|fashion|zara|h&m|gap|old navy|nike|adidas)", "shopping", 0.85),
    (r"(pharmacy|cvs|walgreens|rite aid|drug|medication|rx)", "health", 0.9),
    (r"(doctor|medical|hospital|clinic|urgent care|dental|dentist|vision|optom)", "health", 0.9),
    (r"(carenow|carespot|minute clinic|nextcare|patient first|medexpress)", "health", 0.95),
    (r"(health|healthcare|fitness|gym|planet fitness|la fitness|equinox|peloton)", "health", 0.85),
    (r"(insurance|geico|state farm|allstate|progressive|liberty mutual|usaa)", "insurance", 0.95),
    (r"(insurance premium|coverage|policy)", "insurance", 0.7),
    (r"(adobe|microsoft|office|dropbox|google one|icloud|onedrive)", "subscriptions", 0.9),
    (r"(patreon|substack|medium|linkedin premium|github)", "subscriptions", 0.85),
    (r"(membership|subscription|recurring|monthly fee)", "subscriptions", 0.7),
    (r"(airline|united|delta|american|southwest|jetblue|spirit|frontier)", "travel", 0.95),
    (r"(hotel|marriott|hilton|hyatt|airbnb|vrbo|motel|inn)", "travel", 0.9),
    (r"(expedia|booking|kayak|priceline|trivago)", "travel", 0.9),
    (r"(university|college|tuition|school|education|course|udemy|coursera|skillshare)", "education", 0.9),
    (r"(textbook|student loan|sallie mae|navient)", "education", 0.85),
    (r"(salon|spa|barber|haircut|nail|massage|wax)", "personal", 0.9),
    (r"(beauty|cosmetic|sephora|ulta)", "personal", 0.85),
    (r"(petco|petsmart|pet supplies plus|chewy|pet food|pet store)", "pets", 0.95),
    (r"(veterinar|vet clinic|animal hospital|animal clinic|banfield|vca\b)", "pets", 0.95),
    (r"(dog food|cat food|pet meds|pet pharmacy|1800petmeds)", "pets", 0.9),
    (r"(groomer|pet grooming|dog wash|doggy daycare|pet boarding|pet hotel)", "pets", 0.9),
    (r"(rover|wag\b|pet sit|dog walk|bark box|barkbox)", "pets", 0.85),
    (r"(charity|donation|donate|nonprofit|foundation|red cross|unicef)", "gifts", 0.9),
    (r"(gift|present|flowers|1-800)", "gifts", 0.7),
    (r"(fee|charge|interest|overdraft|late fee|penalty|finance charge)", "fees", 0.85),
    (r"(atm|withdrawal|service charge)", "fees", 0.8),
    (r"(transfer|zelle|venmo|paypal|cash app|wire|ach)", "transfer", 0.85),
    (r"(credit card payment|payment to|bill pay)", "transfer", 0.9),
]
